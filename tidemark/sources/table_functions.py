"""The parsers of texts as table functions, for plans that are SQL alone.

After install(spark), `SELECT f.file, r.* FROM files f, LATERAL routes(f.text) r` gives a row for
each route of each text, as parsed(files, rust.routes, ...) does. Rows travel as Arrow batches, and
Spark deals the texts out over the tasks that hold them. A null or empty text has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidemark.sources import js, run_logs, rust
from tidemark.streaming.logs import Segments, Trace


def items(text: str) -> Iterator[tuple]:
    """(kind, name, line, of, trait, detail): functions with a body, methods of trait implementations, type aliases.

    of: the type that a method or an alias is of; detail: the type arguments of the trait.
    """
    for f in rust.functions(rust.mask(text)):
        yield "function", f.name, f.line, None, None, None
    for trait, trait_args, of, method, line in rust.impls(text):
        yield "method", method, line, of, trait, trait_args
    for alias, of, _ in rust.aliases(text):
        yield "alias", alias, None, of, None, None


def trace_lines(text: str) -> Iterator[tuple]:
    """(rec, source, pos, line, hits) of an lcov trace."""
    state: dict = {}
    for rec, source, lines, hits in chain(Trace().feed(state, text), Trace().end(state)):
        yield from ((rec, source, pos, *x) for pos, x in enumerate(zip(lines, hits)))
        if not lines:
            yield rec, source, None, None, None


#: name: parser of a text, columns of its rows.
FUNCTIONS: dict[str, tuple[Callable, str]] = {
    "rust_items": (items, "kind string, name string, line int, of string, trait string, detail string"),
    "routes": (rust.routes, "method string, path string, handler string, ord int"),
    "js_blocks": (
        js.flow_configs,
        "flow string, raw_block string, response_status int, request_fields map<string,string>, has_amount_to_capture boolean, has_enable_overcapture boolean",
    ),
    "spec_tests": (js.tests, "test_name string, line int, skipped boolean"),
    "lcov_lines": (trace_lines, Trace.columns),
    "log_segments": (run_logs.segments, Segments.columns),
}


def _table_function(parser: Callable):
    class OfText:
        def eval(self, text: str):
            if text:
                yield from parser(text)

    return OfText


def install(spark: SparkSession) -> None:
    """Makes the table functions known to a session's SQL; those it has by these names are replaced."""
    for name, (parser, columns) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(_table_function(parser), returnType=columns, useArrow=True))
