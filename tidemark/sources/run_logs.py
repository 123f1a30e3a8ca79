"""Terminal output of test runs: what needs a whole text at once; counters and failures are in operators.report."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator


def number(text: str | None) -> int:
    """A count in a results table; '-' and nothing are 0."""
    return int(text) if text and text.isdigit() else 0


def _closed(text: str) -> set[int]:
    """Positions of the braces that are closed somewhere."""
    open_at, out = [], set()
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            open_at.append(m.start())
        elif open_at:
            out.add(open_at.pop())
    return out


def bodies(text: str) -> list[str]:
    """JSON objects that stand in a log, whole, one-line ones too. Braces that are never closed aren't tried."""
    out, stop, decoder = [], 0, json.JSONDecoder()
    for at in sorted(_closed(text)):
        if at < stop:
            continue
        try:
            _, stop = decoder.raw_decode(text, at)
            out.append(text[at:stop])
        except (ValueError, RecursionError):
            pass
    return out


def first_object(text: str, fields: tuple[str, ...] = ("verdict", "reason")) -> str | None:
    """The first JSON object in an answer that may be fenced or surrounded by prose.

    Where none can be read, an object of those fields that are said as "name": "value" or name: value.
    """
    found = bodies(re.sub(r"```(?:json)?", "", text))
    if found:
        return found[0]
    said = {f: m[1] or m[2] for f in fields if (m := re.search(rf'"?{f}"?\s*[:=]\s*(?:"([^"\n]*)"|([^\n,}}]+))', text))}
    return json.dumps({k: v.strip() for k, v in said.items()}) if said else None


# a list: its pattern, how many it has at most, what is in every text that has one
_SEGMENT = {
    k: (re.compile(p, re.MULTILINE), n, re.compile(sign))
    for k, p, n, sign in (
        ("request_ids", r"x-request-id\s*->\s*([A-Za-z0-9-]+)", 100, "x-request-id"),
        ("steps", r"STEP:\s+([^\n]+)", 100, "STEP:"),
        ("statuses", r"status(?:_code)?\D{0,3}(\d{3})\b", 6, "status"),
        ("failed", r"^\s+\d+\)\s+([^\n]+)", 5, r"\d\)\s"),
    )
}
_RUNNING = re.compile(r"Running:\s+(\S+\.cy\.js)")
_TABLE = re.compile(r"(Tests|Passing|Failing|Duration):\s+([^\n│|]+)")
_MESSAGES = (re.compile(r'"message":\s*"([^"]+)"'), re.compile(r"Error:\s+([^\n]+)"))
_COLOUR = re.compile(r"\x1b\[[0-9;]*m")


def _once(found: list[str], n: int) -> list[str]:
    """The first n different ones, without the blanks around them."""
    return list(dict.fromkeys([x.strip() for x in found]))[:n]


def segments(text: str) -> Iterator[tuple]:
    """One row per spec of a run: spec, tests, passing, failing, duration, status, request_ids, steps, messages, statuses, failed."""
    starts = list(_RUNNING.finditer(text))
    for m, stop in zip(starts, [*(s.start() for s in starts[1:]), len(text)]):
        block = plain(text[m.start() : stop])
        if "(Results)" not in block:
            continue
        table = dict(_TABLE.findall(block))
        tests, passing, failing = (number((table.get(k) or "").strip()) for k in ("Tests", "Passing", "Failing"))
        once = {k: _once(p.findall(block), n) if sign.search(block) else [] for k, (p, n, sign) in _SEGMENT.items()}
        said = [x for p in _MESSAGES for x in p.findall(block)]
        status = "failed" if failing else "ok" if passing else "partial"
        yield (
            m[1], tests, passing, failing, (table.get("Duration") or "").strip(), status, once["request_ids"], once["steps"],
            _once(said, 4), once["statuses"], once["failed"],
        )


def plain(text: str) -> str:
    """text without terminal colours."""
    return _COLOUR.sub("", text) if "\x1b" in text else text
