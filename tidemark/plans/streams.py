"""Queries over logs and traces that arrive in slices: streams with state, held against the tables their texts were made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.sources import files_of, run_texts, said, shown_segments, traces
from tidemark.plans.views import oracle, view
from tidemark.registry import oracle_of, register
from tidemark.sources import coverage_files as C
from tidemark.streaming import logs

@register(
    "sliced_failed_names",
    oracle(
        "SELECT 'run' || file_id AS file, n AS line_no, 'pays by ' || event_type AS test FROM (SELECT file_id, line_no, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS n,"
        " min(CASE WHEN line_no % 13 = 0 THEN line_no END) OVER (PARTITION BY file_id) AS first FROM v_run_log) JOIN events ON event_id = line_no WHERE line_no > first AND line_no % 13 = 1"
    ),
)
def sliced_failed_names(spark, sf):
    texts = files_of(view(spark, sf, "v_run_log"), said("run", "$file_id"), ["line_no"], F.col("txt"))
    return logs.read_files(texts, logs.FailedNames(), chars=512)


@register("sliced_run_segments", oracle_of("run_segments"))
def sliced_run_segments(spark, sf):
    return shown_segments(logs.read_files(run_texts(spark, sf), logs.Segments(), chars=1024))


@register("sliced_traces", oracle_of("lcov_records"))
def sliced_traces(spark, sf):
    found = C.lcov_merged(logs.read_files(traces(spark, sf, F.lit(1)), logs.Trace()), root="/src")
    return found.select("file", F.col("line").cast("long").alias("line"), "hits")
