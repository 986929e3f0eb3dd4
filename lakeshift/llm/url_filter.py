"""URL filter by pattern rules (native: DataFrame operations only).

A rule names a host and a path prefix, ``net/`` or ``example.net/en/``; it fits its host and
all subdomains when the url's path starts with the rule's path, and the longest rule that
fits wins.  Every rule becomes a regular expression over ``host + path``, and an entry of an
index under its *rarest literal token*: of the host labels and whole path segments that any
fitting url must hold, the one that the fewest distinct urls of the table hold.  The tokens of a
url fetch candidate rules from that index, and only those run their expression.

Tokens are made and judged once per distinct (host, path), after a map-side aggregate, so a
host with a third of all rows costs no more than its distinct paths; the verdicts are then
joined back to the rows.  The rules come from the driver, as a list, so the index is bounded by
what a caller can write down; Spark broadcasts it when its known size is below the
session's threshold and shuffles by token otherwise.

Defined results: a url that is null or has no ``://`` has an empty host and path; a path may be
empty (``http://a.net``), and no rule with a path ``/`` fits it; a url that no rule fits gets
``default``; equally long rules go by block before allow, then by text; repeated rows
are all judged; an empty table gives no rows; columns other than ``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """``(host, path)``: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _rule_row(verdict: str, rule: str) -> tuple:
    host, slash, path = rule.partition("/")
    path = slash + path
    *whole, _ = path.split("/")  # the last segment may go on in the url
    tokens = [f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in whole if x]
    pattern = r"^(?:[^/]*\.)?" + "".join(c if c.isalnum() else re.escape(c) for c in host) + "(?=/|$)" + "".join(c if c.isalnum() or c == "/" else re.escape(c) for c in path)
    return rule, verdict, len(rule), pattern, sorted(set(tokens))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages``."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    distinct = rows.select("host", "path").distinct()
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("p:"), x))
    tokens = distinct.select("host", "path", F.explode(F.array_distinct(F.concat(labels, segments))).alias("token"))

    listed = spark.createDataFrame([_rule_row(*r) for r in rules], "rule string, verdict string, length int, pattern string, tokens array<string>")
    literal = listed.select("*", F.explode("tokens").alias("token")).drop("tokens")
    seen = tokens.join(literal.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counted = literal.join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    index = counted.groupBy("rule", "verdict", "length", "pattern").agg(F.min(F.struct("n", "token")).alias("rarest"))
    index = index.select("rule", "verdict", "length", "pattern", F.col("rarest.token").alias("token"))

    # a rule without a literal token would have no entry
    candidates = tokens.join(index, "token").filter(F.expr("concat(host, path) rlike pattern"))
    order = F.struct(F.col("length"), (F.col("verdict") == "block"), F.col("rule"))
    best = candidates.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
