"""What the analytics need of Rust sources, found by a small scanner instead of a full parser.

mask() blanks out comments and the insides of string and character literals, keeping length and
line ends, so that braces and keywords are counted where they are code. Limits: macros are not
expanded, and a `<` that compares is told from one that opens type arguments by its surroundings.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

_LITERAL = re.compile(
    r"""//[^\n]*|/\*.*?(?:\*/|\Z)|\bb?r(?P<h>\#*)".*?(?:"(?P=h)|\Z)|b?"(?:[^"\\]|\\.)*(?:"|\Z)|b?'(?:\\.[^']*|[^'\\\n])'""", re.S
)
_ELSE = re.compile(r"\s*else\b")
# Names too common to tell a callee, and what a control keyword is reported as.
NOISE = {
    "map",
    "ok",
    "err",
    "into",
    "from",
    "unwrap",
    "expect",
    "clone",
    "len",
    "push",
    "pop",
    "get",
    "set",
    "new",
    "default",
    "iter",
    "collect",
    "flatten",
    "filter",
    "and_then",
    "or_else",
    "ok_or",
    "ok_or_else",
    "map_err",
    "is_some",
    "is_none",
    "is_empty",
    "to_string",
    "to_owned",
    "as_ref",
    "as_mut",
    "as_str",
    "try_from",
    "try_into",
    "into_iter",
    "next",
    "await",
    "lock",
    "read",
    "write",
    "send",
    "recv",
    "spawn",
    "box_err",
    "change_context",
    "attach_printable",
}
#: Shortest name of a callee that is looked at, and the longest text of a condition that is kept.
NAME_CHARS, CONDITION_CHARS = 4, 300
GUARDS = {"if": "if", "match": "match", "while": "while", "for": "for"}


def mask(text: str) -> str:
    """text with comments blank and literals reduced to their delimiters."""

    def blank(m: re.Match) -> str:
        s = m[0]
        inner = re.sub(r"[^\n]", " ", s)
        return inner if s[0] == "/" else s[0] + inner[1:-1] + s[-1] if len(s) > 1 else s

    return _LITERAL.sub(blank, text)


class Lines:
    """Offsets to line numbers from 1."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)


class Braces:
    """Depth of every offset, and where what opens closes, from one pass."""

    def __init__(self, code: str):
        self.at, self.depths, self.ends, open_ = [], [], {}, []
        for m in re.finditer(r"[{}]", code):
            if m[0] == "{":
                open_.append(m.start())
            elif open_:
                self.ends[open_.pop()] = m.start()
            self.at.append(m.start())
            self.depths.append(len(open_))

    def depth(self, offset: int) -> int:
        """How many braces are open before offset."""
        k = bisect.bisect_left(self.at, offset)
        return self.depths[k - 1] if k else 0


def closing(code: str, start: int, pair: str = "{}") -> int:
    """Offset of what closes the bracket at start, or -1."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(code, start):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.start()
    return -1


def angle(code: str, start: int) -> int:
    """Offset after the > that closes the < at start."""
    depth = 0
    for k in range(start, len(code)):
        if code[k] == "<":
            depth += 1
        elif code[k] == ">" and code[k - 1] not in "-=":
            depth -= 1
            if depth == 0:
                return k + 1
    return len(code)


def short(name: str) -> str:
    """Last path segment without generics."""
    return name.split("<")[0].rsplit("::", 1)[-1].strip().rstrip(">()")


def arguments(text: str) -> list[str]:
    """Top-level comma-separated parts."""
    out, depth, last = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "<([{") - (c in ")]}" or (c == ">" and text[k - 1 : k] not in ("-", "=")))
        if c == "," and depth == 0:
            out.append(text[last:k].strip())
            last = k + 1
    return [x for x in [*out, text[last:].strip()] if x]


@dataclass
class Function:
    name: str
    line: int
    start: int
    body: int
    end: int


def functions(code: str) -> list[Function]:
    """Functions that have a body, in order."""
    at = Lines(code)
    out = []
    for m in re.finditer(r"\bfn\s+([A-Za-z_]\w*)", code):
        k = m.end()
        while k < len(code) and code[k] not in "{;":
            k = angle(code, k) if code[k] == "<" else closing(code, k, "()") + 1 if code[k] == "(" and closing(code, k, "()") > 0 else k + 1
        if k < len(code) and code[k] == "{" and (end := closing(code, k)) > 0:
            out.append(Function(m[1], at.of(m.start()), m.start(), k, end))
    return out


def impls(text: str) -> Iterator[tuple]:
    """(trait, trait_args, type, method, line) of every method of every `impl Trait for Type` block."""
    code = mask(text)
    for m in re.finditer(r"\bimpl\b", code):
        k = m.end()
        while k < len(code) and code[k].isspace():
            k += 1
        if code[k : k + 1] == "<":
            k = angle(code, k)
        brace = code.find("{", k)
        head = code[k:brace] if brace > 0 else ""
        cut = re.search(r"\bfor\b(?!\s*<)", head)
        if not cut or ";" in head:
            continue
        trait, type_ = head[: cut.start()].strip().lstrip("!"), re.split(r"\bwhere\b", head[cut.end() :])[0].strip()
        open_ = trait.find("<")
        args = [short(a) for a in arguments(trait[open_ + 1 : trait.rfind(">")]) if not a.startswith("'")] if open_ > 0 else []
        end = closing(code, brace)
        for f in functions(code[brace + 1 : end]):
            depth = code[brace + 1 : brace + 1 + f.start].count("{") - code[brace + 1 : brace + 1 + f.start].count("}")
            if depth == 0:
                yield short(trait), ",".join(args), short(type_.lstrip("&").removeprefix("dyn ")), f.name, Lines(code).of(brace + 1 + f.start)


def generic_calls(text: str) -> Iterator[tuple]:
    """(callee, type_param, line): the first concrete type of a turbofish call, or a struct literal as first argument."""
    code = mask(text)
    at = Lines(code)
    for m in re.finditer(r"([A-Za-z_][\w:.]*?)::<", code):
        end = angle(code, m.end() - 1)
        if code[end : end + 1] == "(":
            names = [short(a) for a in arguments(code[m.end() : end - 1]) if re.fullmatch(r"[A-Za-z_][\w:]*", a)]
            first = next((n for n in names if n and n != "_"), None)
            if first:
                yield short(m[1].replace(".", "::")), first, at.of(m.start())
    for m in re.finditer(r"([A-Za-z_][\w:.]*)\(\s*([A-Z][\w:]*)\s*\{", code):
        if not re.search(r"\b(?:fn|if|match|while)\s*$", code[: m.start()]):
            yield short(m[1].replace(".", "::")), short(m[2]), at.of(m.start())


def aliases(text: str) -> Iterator[tuple]:
    """(alias, type, ord) of `type A = [dyn] G<First, ...>` with a CamelCase first argument of more than two letters."""
    for k, m in enumerate(re.finditer(r"\btype\s+(\w+)(?:<[^=;]*>)?\s*=\s*(?:dyn\s+)?[\w:]+<\s*([A-Z]\w{2,})\b", mask(text))):
        yield m[1], m[2], k


def bindings(text: str) -> Iterator[tuple]:
    """(function_line, variable, type) of let bindings with a stated or constructed type."""
    code = mask(text)
    for f in functions(code):
        for m in re.finditer(r"\blet\s+(?:mut\s+)?(\w+)\s*(?::\s*&?(?:mut\s+)?([A-Z]\w*))?\s*=\s*(?:&?([A-Z]\w*)\s*(?:\{|::))?", code[f.body : f.end]):
            if m[2] or m[3]:
                yield f.line, m[1], m[2] or m[3]


def bound_calls(text: str) -> Iterator[tuple]:
    """(callee, type_param, line) of calls all of whose bound arguments have one and the same type."""
    code = mask(text)
    at = Lines(code)
    types: dict[int, dict[str, str]] = {}
    for line, var, type_ in bindings(text):
        types.setdefault(line, {})[var] = type_
    for f in functions(code):
        known = types.get(f.line, {})
        for m in re.finditer(r"([A-Za-z_][\w:.]*)\(", code[f.body : f.end]):
            start = f.body + m.end() - 1
            end = closing(code, start, "()")
            own = {known[v] for a in arguments(code[start + 1 : end]) if (v := re.sub(r"^&?(?:mut\s+)?", "", a)) in known}
            if len(own) == 1:
                yield short(m[1].replace(".", "::")), own.pop(), at.of(f.body + m.start())


def body_calls(text: str) -> Iterator[tuple]:
    """(function, function_line, callee, line) of the calls in every body, each callee once: names of NAME_CHARS letters or more that are not noise."""
    code = mask(text)
    at = Lines(code)
    for f in functions(code):
        first: dict[str, int] = {}
        for m in re.finditer(r"\b([a-z_]\w*)\s*(?:::<[^;{}]*?>)?\(", code[f.body : f.end]):
            if len(m[1]) >= NAME_CHARS and m[1] not in NOISE:
                first.setdefault(m[1], at.of(f.body + m.start()))
        for name, line in sorted(first.items()):
            yield f.name, f.line, name, line


def guard_spans(text: str) -> Iterator[tuple]:
    """(lo, hi, depth, kind, condition, arm) of every block under a condition.

    Functions and closures with a body of their own come as kind stop: the search outwards ends
    there. A match comes once as a whole and once for each of its arms, with the arm's pattern.
    """
    code = mask(text)
    at, braces = Lines(code), Braces(code)
    for f in functions(code):
        yield f.line, at.of(f.end), braces.depth(f.body), "stop", "", None
    for m in re.finditer(r"(?<=[(,=\s])(?:move\s+)?\|[^|;{}]*\|\s*(?:->\s*[\w:<>, ]+\s*)?(?:async\s+(?:move\s+)?)?(?=\{)", code):
        if m.end() in braces.ends:
            yield at.of(m.start()), at.of(braces.ends[m.end()]), braces.depth(m.end()), "stop", "", None
    for m in re.finditer(r"\b(if|match|while|for)\b", code):
        k = m.end()
        while k < len(code) and code[k] not in "{;":
            k = closing(code, k, "()") + 1 if code[k] == "(" and closing(code, k, "()") > 0 else k + 1
        if k >= len(code) or code[k] != "{" or k not in braces.ends:
            continue
        if "=>" in code[m.end() : k]:
            continue  # an arm's own condition
        condition = re.sub(r"\s+", " ", text[m.end() : k]).strip()[:CONDITION_CHARS]
        if m[1] == "for" and " in " not in f" {condition} ":
            continue
        kind = GUARDS[m[1]] + ("_let" if m[1] in ("if", "while") and condition.startswith("let ") else "")
        depth, end = braces.depth(k), braces.ends[k]
        while m[1] == "if" and (other := _ELSE.match(code, end + 1)) and (brace := code.find("{", other.end())) in braces.ends:
            end = braces.ends[brace]  # what stands under else depends on the condition as well
        yield at.of(m.start()), at.of(end), depth, kind, condition, None
        if kind == "match":
            for start, stop, pattern in arms(text, code, k + 1, end):
                yield at.of(start), at.of(stop), depth, kind, condition, pattern[:CONDITION_CHARS]


def arms(text: str, code: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """(first offset, last offset, pattern) of the arms of the match block between start and end."""
    depth, pattern, arrow = 0, None, None
    k = start
    while k < end:
        c = code[k]
        if pattern is None and not c.isspace() and c != ",":
            pattern = k
        if arrow is None and depth == 0 and code.startswith("=>", k):
            arrow = k
            k += 2
            continue
        depth += (c in "([{") - (c in ")]}")
        # an arm ends with a comma, or with the brace of its body
        block = c == "}" and depth == 0 and arrow is not None and re.match(r"\s*\{", code[arrow + 2 : end]) is not None
        if arrow is not None and depth == 0 and (c == "," or block):
            yield pattern, k, re.sub(r"\s+", " ", text[pattern:arrow]).strip()
            pattern = arrow = None
        k += 1
    if arrow is not None:
        yield pattern, end, re.sub(r"\s+", " ", text[pattern:arrow]).strip()


# Functions that are handed an operation to carry out, and how names of operations begin and those of mere data end.
DISPATCHERS = ("payments_operation_core", "proxy_for_payments_operation_core", "payments_core")
OPERATION, DATA = re.compile("Payment|Complete"), ("Data", "Response", "Request", "Types")


def dispatched(text: str) -> Iterator[tuple]:
    """(function, function_line, op) of functions that hand an operation on: the first type argument that is one, else the first argument."""
    code = mask(text)
    call = re.compile(rf"\b(?:{'|'.join(DISPATCHERS)})\s*(?P<types>::\s*<)?\(?")
    for f in functions(code):
        for m in call.finditer(code, f.body, f.end):
            end = angle(code, m.end("types") - 1) if m["types"] else m.end() - 1
            if code[end : end + 1] != "(":
                continue
            types = [short(a) for a in arguments(code[m.end("types") : end - 1])[:1]] if m["types"] else []
            passed = arguments(code[end + 1 : closing(code, end, "()")])
            # a struct or a path names its type; a call of Type::function names it before the last part
            heads = [(re.match(r"&?\s*([A-Za-z_][\w:]*(?:<[^()]*>)?)\s*(\(?)", a), a) for a in passed]
            named = [short(h[1].rsplit("::", 1)[0] if h[2] and "::" in h[1] else h[1]) for h, _ in heads if h and not (h[2] and "::" not in h[1])]
            op = next((t for t in types if OPERATION.match(t)), None) or next((n for n in named if OPERATION.match(n) and not n.endswith(DATA)), None)
            if op:
                yield f.name, f.line, op
                break


def public_functions(text: str) -> Iterator[tuple]:
    """(name, line) of every public function."""
    for k, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*pub(?:\([^)]*\))?\s+(?:async\s+)?fn\s+(\w+)", line):
            yield m[1], k


def struct_fields(text: str, field: str) -> Iterator[tuple]:
    """(struct, line) of lines that mention field, under the struct that was opened last."""
    current = None
    for k, line in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*(?:pub\s+)?struct\s+(\w+)", line):
            current = m[1]
        if current and field in line:
            yield current, k


def body_span(text: str, def_line: int) -> tuple[int, int] | None:
    """First and last line of the first function's body in a snippet that starts at def_line."""
    found = functions(mask(text))
    if not found:
        return None
    at = Lines(text)
    return def_line + at.of(found[0].body) - 1, def_line + at.of(found[0].end) - 1


def snippet(text: str, line: int, most: int = 300) -> str:
    """The source of the function defined at line: up to the line its braces close, most lines at the longest."""
    code = mask(text)
    rows = text.split("\n")
    for f in functions(code):
        if f.line == line:
            return "\n".join(rows[line - 1 : min(Lines(text).of(f.end), line - 1 + most)])
    return "\n".join(rows[line - 1 : line])


def routes(text: str) -> Iterator[tuple]:
    """(method, path, handler, ord) of route registrations.

    A scope covers what is indented deeper than it; a resource lasts until the next resource or
    scope. Paths with a segment v2 are left out.
    """
    token = re.compile(r'web::(?:(scope|resource)\(\s*"([^"]*)"\s*\)|([a-z]+)\(\)\s*\.to\(([A-Za-z_][\w:]*)\))')
    scopes: list[tuple[int, str]] = []
    resource, n = "", 0
    for row in text.splitlines():
        indent = len(row) - len(row.lstrip())
        for m in token.finditer(row):
            scopes = [s for s in scopes if s[0] < indent]
            if m[1] == "scope":
                scopes.append((indent, m[2]))
                resource = ""
            elif m[1] == "resource":
                resource = m[2]
            else:
                parts = [p for s in (*(p for _, p in scopes), resource) for p in s.split("/") if p]
                if "v2" not in parts:
                    yield m[3].upper(), "/" + "/".join(parts), short(m[4]), n
                    n += 1


def gates(text: str, marker: str) -> Iterator[tuple]:
    """(op, gate) of the arms of the first match after marker: always_true, always_false or conditional; _default for the wildcard."""
    start = text.find(marker)
    if start < 0 or not (m := re.compile(r"\bmatch\b[^\n]*?\{\s*\n").search(text, start)):
        return
    body = text[m.end() : closing(mask(text), m.end() - 1 - (len(m[0]) - len(m[0].rstrip())))]
    value = {"true": "always_true", "false": "always_false"}
    arms = [(a.start(), a.end(), a[1]) for a in re.finditer(r'(?m)^\s*(?:"(\w+)"|_)\s*=>', body)]
    default = "always_false"
    for (_, end, op), nxt in zip(arms, [*(a[0] for a in arms[1:]), len(body)]):
        said = body[end:nxt].strip().rstrip(",").strip()
        if op is None:
            default = value.get(said, "always_false")
        else:
            yield op, value.get(said, "conditional")
    yield "_default", default
