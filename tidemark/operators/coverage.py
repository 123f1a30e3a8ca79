"""Coverage queries: roll-ups, gaps, rankings and build comparison.

Frames: lines (tag, file, line, hits; -1 not instrumented), files (tag, file, line_total,
line_covered, line_missed), funcs (tag, file, func_name, start_line, cnt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of an untested function against a missed line.
FUNC_WEIGHT = 3


def percent(covered: Column, total: Column) -> Column:
    return F.coalesce(F.round(100.0 * F.try_divide(covered.cast("double"), total.cast("double")), 2), F.lit(0.0))


def ordering(sort_by: str) -> list[Column]:
    """missed (default, and for unknown keys), percent or name; the file name breaks ties."""
    keys = {"percent": [F.col("pct").asc()], "name": []}
    return [*keys.get(sort_by, [F.col("line_missed").desc()]), F.col("file").asc()]


def with_percent(files: DataFrame) -> DataFrame:
    return files.withColumn("pct", percent(F.col("line_covered"), F.col("line_total")))


def summary(files: DataFrame) -> DataFrame:
    """tag, files, covered, missed, total, pct."""
    out = files.groupBy("tag").agg(
        F.count(F.lit(1)).alias("files"), F.sum("line_covered").alias("covered"), F.sum("line_missed").alias("missed"), F.sum("line_total").alias("total")
    )
    return out.withColumn("pct", percent(F.col("covered"), F.col("total")))


def folder_totals(files: DataFrame, tag: str, folder: str) -> DataFrame:
    """Sums over the files whose path contains folder."""
    return summary(files.where((F.col("tag") == tag) & F.contains(F.col("file"), F.lit(folder)))).drop("tag")


def list_files(files: DataFrame, tag: str, folder: str = "", sort_by: str = "missed", limit: int = 20, prefix: bool = False) -> DataFrame:
    """The first limit files of a folder in the given order."""
    hit = F.startswith(F.col("file"), F.lit(folder)) if prefix else F.contains(F.col("file"), F.lit(folder))
    return with_percent(files.where((F.col("tag") == tag) & hit)).orderBy(*ordering(sort_by)).limit(limit)


def uncovered_lines(lines: DataFrame, first: int = 30) -> DataFrame:
    """tag, file, missed (its first uncovered lines in order), more (how many follow)."""
    zero = lines.where("hits = 0").groupBy("tag", "file").agg(F.array_sort(F.collect_list("line")).alias("all"))
    return zero.select("tag", "file", F.slice("all", 1, first).alias("missed"), F.greatest(F.size("all") - first, F.lit(0)).alias("more"))


def uncovered_topk(files: DataFrame, lines: DataFrame, tag: str, file: str = "", folder: str = "", limit: int = 10, first: int = 20) -> DataFrame:
    """The files with most missed lines, each with its first uncovered lines."""
    hit = (F.col("tag") == tag) & F.contains(F.col("file"), F.lit(file)) & F.startswith(F.col("file"), F.lit(folder)) & (F.col("line_missed") > 0)
    top = files.where(hit).orderBy(F.desc("line_missed"), "file").limit(limit)
    return top.join(uncovered_lines(lines.where(F.col("tag") == tag), first), ["tag", "file"], "left").select("file", "line_missed", "missed", "more")


METRICS = (("lines", "line"), ("functions", "func"), ("regions", "region"))


def _totals(files: DataFrame, funcs: DataFrame) -> DataFrame:
    """One row: files, functions, and covered and total of lines, functions and regions (null where the files have no regions)."""
    f = funcs.agg(F.count_if(F.col("cnt") > 0).alias("func_covered"), F.count(F.lit(1)).alias("func_total"))
    has = "region_total" in files.columns
    region = [(F.sum(c) if has else F.lit(None).cast("long")).alias(c) for c in ("region_covered", "region_total")]
    t = files.agg(F.count(F.lit(1)).alias("files"), F.sum("line_covered").alias("line_covered"), F.sum("line_total").alias("line_total"), *region)
    return t.crossJoin(f)  # one row each


def overall(files: DataFrame, funcs: DataFrame, tag: str) -> DataFrame:
    """metric (lines, functions, regions), covered, total, missed, pct, and of the whole report files and functions."""
    rows = _totals(files.where(F.col("tag") == tag), funcs.where(F.col("tag") == tag))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{c}_covered").cast("long").alias("covered"), F.col(f"{c}_total").cast("long").alias("total")) for m, c in METRICS])
    rows = rows.select("files", F.col("func_total").alias("functions"), F.explode(each).alias("m")).select("m.*", "files", "functions")
    pct = F.when(F.col("total").isNotNull(), percent(F.col("covered"), F.col("total")))
    return rows.select("metric", "covered", "total", (F.col("total") - F.col("covered")).alias("missed"), pct.alias("pct"), "files", "functions")


def _of_connector(rows: DataFrame, tag: str, name: str) -> DataFrame:
    return rows.where((F.col("tag") == tag) & F.contains(F.lower("file"), F.lit(name.lower())))


def connector(files: DataFrame, funcs: DataFrame, tag: str, name: str) -> DataFrame:
    """One row: line, function and region sums and their shares over the files whose path contains name in any case."""
    t = _totals(_of_connector(files, tag, name), _of_connector(funcs, tag, name))
    return t.select("files", *[x for _, c in METRICS for x in (f"{c}_covered", f"{c}_total", percent(F.col(f"{c}_covered"), F.col(f"{c}_total")).alias(f"{c}_pct"))])


def connector_files(files: DataFrame, funcs: DataFrame, tag: str, name: str) -> DataFrame:
    """The files behind connector(), each with its lines and functions, least covered first."""
    own = _of_connector(funcs, tag, name).groupBy("file").agg(F.count_if(F.col("cnt") > 0).alias("func_covered"), F.count(F.lit(1)).alias("func_total"))
    rows = with_percent(_of_connector(files, tag, name)).join(own, "file", "left").fillna(0, ["func_covered", "func_total"])
    rows = rows.select("file", "line_covered", "line_total", F.col("pct").alias("line_pct"), "func_covered", "func_total", percent(F.col("func_covered"), F.col("func_total")).alias("func_pct"))
    return rows.orderBy("line_pct", "file")


def function_tested(funcs: DataFrame, tag: str, name: str, limit: int = 5) -> DataFrame:
    """tested, pos, func_name, file, matches: the first limit matches of either kind and how many there are."""
    hit = funcs.where((F.col("tag") == tag) & F.contains(F.lower("func_name"), F.lit(name.lower()))).withColumn("tested", F.col("cnt") > 0)
    order = Window.partitionBy("tested").orderBy("func_name", "file")
    first = hit.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= limit)
    counts = hit.groupBy("tested").agg(F.count(F.lit(1)).alias("matches"))
    return first.join(counts, "tested").select("tested", "pos", "func_name", "file", "matches")


def file_stats(files: DataFrame, funcs: DataFrame) -> DataFrame:
    """files with func_total, func_missed and impact (untested functions weigh FUNC_WEIGHT lines)."""
    f = funcs.groupBy("tag", "file").agg(F.count(F.lit(1)).alias("func_total"), F.count_if(F.col("cnt") == 0).alias("func_missed"))
    out = files.join(f, ["tag", "file"], "left").withColumns(
        {"func_total": F.coalesce("func_total", F.lit(0)).cast("long"), "func_missed": F.coalesce("func_missed", F.lit(0)).cast("long")}
    )
    return out.withColumn("impact", F.col("func_missed") * FUNC_WEIGHT + F.col("line_missed"))


def uncovered_functions(files: DataFrame, funcs: DataFrame, tag: str, limit: int = 10, first: int = 15) -> DataFrame:
    """The files with most untested functions, each with its first ones: last name segment, 80 characters."""
    top = file_stats(files, funcs).where((F.col("tag") == tag) & (F.col("func_missed") > 0)).orderBy(F.desc("func_missed"), "file").limit(limit)
    order = Window.partitionBy("file").orderBy("start_line", "func_name")
    own = funcs.where((F.col("tag") == tag) & (F.col("cnt") == 0)).join(top.select("file", "func_missed"), "file")
    own = own.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= first)
    return own.select("file", "func_missed", "pos", F.substring(F.element_at(F.split("func_name", "::"), -1), 1, 80).alias("func_name"), "start_line")


def zero_coverage(files: DataFrame, funcs: DataFrame, tag: str, prefix: str = "", limit: int = 20) -> DataFrame:
    """Files with lines none of which was ever run."""
    hit = (F.col("tag") == tag) & F.startswith(F.col("file"), F.lit(prefix)) & (F.col("line_total") > 0) & (F.col("line_covered") == 0)
    return file_stats(files.where(hit), funcs).orderBy(F.desc("line_total"), "file").limit(limit).select("file", "line_total", "func_total")


def search_function(funcs: DataFrame, tag: str, name: str) -> DataFrame:
    """Untested functions whose name contains name in any case."""
    return funcs.where((F.col("tag") == tag) & (F.col("cnt") == 0) & F.contains(F.lower("func_name"), F.lit(name.lower()))).select("file", "func_name", "start_line")


def compare(files: DataFrame, base: str, head: str, changed: DataFrame | None = None, funcs: DataFrame | None = None) -> DataFrame:
    """file, base_pct, head_pct, delta, change (new, removed, regression, improvement, same) between two builds.

    Only of the files in changed (file) if given. With funcs also base_func, head_func and
    func_delta, and a file whose functions lost is a regression too.
    """
    rows = with_percent(files)
    if changed is not None:
        rows = rows.join(changed.select("file").distinct(), "file", "left_semi")
    if funcs is not None:
        own = funcs.groupBy("tag", "file").agg(F.count_if(F.col("cnt") > 0).alias("c"), F.count(F.lit(1)).alias("n"))
        rows = rows.join(own.select("tag", "file", percent(F.col("c"), F.col("n")).alias("func")), ["tag", "file"], "left").fillna(0.0, ["func"])
    cols = ["pct"] + (["func"] if funcs is not None else [])
    b = rows.where(F.col("tag") == base).select("file", *[F.col(c).alias(f"base_{c}") for c in cols])
    h = rows.where(F.col("tag") == head).select("file", *[F.col(c).alias(f"head_{c}") for c in cols])
    out = b.join(h, "file", "full").withColumn("delta", F.round(F.col("head_pct") - F.col("base_pct"), 2))
    worse = F.col("delta") < 0
    if funcs is not None:
        out = out.withColumn("func_delta", F.round(F.col("head_func") - F.col("base_func"), 2))
        worse = worse | (F.col("func_delta") < 0)
    change = (
        F.when(F.col("base_pct").isNull(), "new").when(F.col("head_pct").isNull(), "removed").when(worse, "regression")
        .when(F.col("delta") > 0, "improvement").otherwise("same")
    )
    return out.withColumn("change", change)


#: How many files of each kind of change a report lists.
LISTED = {"regression": 20, "improvement": 10, "new": 10, "removed": 10}


def comparison_lists(compared: DataFrame) -> DataFrame:
    """change, pos, matches and the columns of compare(): the files that a report lists of each kind, the largest change first."""
    rows = compared.where(F.col("change").isin(*LISTED))
    largest = F.when(F.col("change") == "improvement", -F.col("delta")).when(F.col("change") == "regression", F.col("delta")).otherwise(F.lit(0.0))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("change").orderBy(largest, "file")).cast("long"))
    most = F.create_map(*[x for k, n in LISTED.items() for x in (F.lit(k), F.lit(n))])
    counts = compared.groupBy("change").agg(F.count(F.lit(1)).alias("matches"))
    return rows.where(F.col("pos") <= most[F.col("change")]).join(counts, "change")


def build_delta(files: DataFrame, funcs: DataFrame, base: str, head: str) -> DataFrame:
    """metric, base_pct, head_pct, delta of whole builds."""
    pct = F.col("pct")
    b = overall(files, funcs, base).select("metric", pct.alias("base_pct"))
    h = overall(files, funcs, head).select("metric", pct.alias("head_pct"))
    return b.join(h, "metric").withColumn("delta", F.round(F.col("head_pct") - F.col("base_pct"), 2))


def test_priority(files: DataFrame, funcs: DataFrame, tag: str, prefix: str = "", limit: int = 15) -> DataFrame:
    """Files by impact, greatest first, with their rank."""
    hit = file_stats(files, funcs).where((F.col("tag") == tag) & F.startswith(F.col("file"), F.lit(prefix)))
    top = hit.orderBy(F.desc("impact"), "file").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("impact"), "file")).cast("long")).select("rank", "file", "impact", "func_missed", "line_missed")


def playbook(name: str, files: DataFrame, lines: DataFrame, funcs: DataFrame, tag: str, base: str | None = None, folder: str = "") -> dict[str, DataFrame]:
    """Named compositions: what to look at for a review, a test plan, a regression, a new team member."""
    parts = {
        "summary": lambda: summary(files.where(F.col("tag") == tag)),
        "folder": lambda: list_files(files, tag, folder),
        "uncovered": lambda: uncovered_topk(files, lines, tag, folder=folder),
        "functions": lambda: uncovered_functions(files, funcs, tag),
        "zero": lambda: zero_coverage(files, funcs, tag, folder),
        "compare": lambda: comparison_lists(compare(files, base or tag, tag, funcs=funcs)),
        "priority": lambda: test_priority(files, funcs, tag, folder),
    }
    plans = {
        "pr_review": ("compare", "uncovered", "functions"),
        "test_plan": ("summary", "priority", "functions", "zero"),
        "regression": ("compare", "summary"),
        "onboarding": ("summary", "folder", "zero", "priority"),
    }
    return {k: parts[k]() for k in plans[name]}
