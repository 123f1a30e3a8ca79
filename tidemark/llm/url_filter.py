r"""URL filters: pattern rules indexed by their rarest literal token.

Each rule becomes a regular expression over host + path and the set of literal tokens that any
match must hold as whole tokens. A rule is filed under the one of them that fewest URLs hold
(counted over all URLs). The tokens of a URL fetch the rules filed under them by an equi-join,
and only those rules run their expressions.

Two kinds of rules. Host rules ("example.com/en/") fit a host and all its subdomains when the
path starts with the rule's path; of those that fit, the longest wins, and of equal ones a block.
Pattern rules ("*/adserver/*", with * for anything) decide only where no host rule fits; block
wins over allow. Where nothing fits, the verdict is allow.

Defined results. A null URL, or one without "://", has an empty host and path: no host rule fits
it. Rows with equal URLs are judged once and joined back, so repeats and one very frequent URL
cost little. A rule without a literal token is filed under the empty token, which every URL has.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str
    host: bool = True

    def regex(self) -> str:
        """Over host + path, matched from the start. A host holds no slash, so the first one starts the path."""
        if self.host:
            return r"(?s)^(?:[^/]*\.)?" + quoted(self.pattern)
        return "(?s)^" + ".*".join(quoted(x) for x in self.pattern.split("*")) + "$"

    def tokens(self) -> list[str]:
        """Literal tokens that a match holds whole: those with a delimiter, or the host's start, on both sides."""
        text = ("." if self.host else "") + self.pattern
        return sorted(set(re.findall(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", text)))


def quoted(text: str) -> str:
    """text as a regular expression that matches it alone."""
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


#: Patterns of the filter's own, for URLs that no host rule covers.
PATTERN_RULES = (
    Rule("block", "*/adserver/*", host=False),
    Rule("block", "*/doubleclick/*", host=False),
    Rule("block", "*.casino.*", host=False),
    Rule("block", "*.porn.*", host=False),
    Rule("block", "*/wp-login.*", host=False),
    Rule("block", "*/cgi-bin/*", host=False),
)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    out = pages.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("rest"))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    return out.select("page_id", "url", F.translate(host, UPPER, LOWER).alias("host"), path.alias("path"))


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, url, host, path, rule (the host rule that decided, else null), verdict, pattern (of a pattern rule)."""
    spark = pages.sparkSession
    urls = parsed(pages)
    keyed = urls.withColumn("key", F.concat("host", "path"))
    # the URL's tokens; the empty one fetches the rules that have no literal token
    runs = F.split("key", "[^A-Za-z0-9]+")
    tokens = keyed.select("key").distinct().select("key", F.explode(F.array_union(F.array(F.lit("")), runs)).alias("token"))

    rows = [(i, r.verdict, r.pattern, r.host, r.regex()) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "rule_no int, verdict string, pattern string, host_rule boolean, regex string")
    literal = [(i, t) for i, r in enumerate(rules) for t in (r.tokens() or [""])]
    literal = spark.createDataFrame(literal, "rule_no int, token string")
    held = tokens.join(literal.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = (
        literal.join(held, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .select("rule_no", F.col("rarest.token").alias("token"))
        .join(table, "rule_no")
    )

    rank = F.struct(
        F.col("host_rule"),
        F.when(F.col("host_rule"), F.length("pattern")).otherwise(0),
        F.col("verdict") == "block",
        F.col("pattern"),
        F.col("verdict"),
    )
    fits = (
        tokens.join(filed, "token")
        .where(F.expr("key rlike regex"))
        .groupBy("key")
        .agg(F.max(rank).alias("best"))
        .select(
            F.col("key").alias("hit"),
            F.when(F.col("best.host_rule"), F.col("best.pattern")).alias("rule"),
            F.when(~F.col("best.host_rule"), F.col("best.pattern")).alias("pattern"),
            F.col("best.verdict").alias("found"),
        )
    )
    return keyed.join(fits, keyed["key"] == fits["hit"], "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("found", F.lit("allow")).alias("verdict"), "pattern"
    )
