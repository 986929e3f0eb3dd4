"""Mixing sources to target weights (native: DataFrame operations only).

Every document gets a hash-random key, an MD5, so uniform.  Within each source
the rows are range-sorted by that key: the key's range is cut into equal slices of about
``ROWS_PER_SLICE`` rows, so that no task holds a whole source, however large.  The prefix
sums are distributed: one sum per (source, slice), a running sum over the slices of a source,
and a running sum over the rows inside a slice.  A source is cut at exactly its budget: it
gives ``budget / size`` whole epochs, then the documents whose prefix sum is below the rest,
the last of them cut to the words that are left (joined by one space).

Targets: sources in order of code point, null last, weigh 5, 2, 1, repeating, and share
``total`` words (by default all words there are); a target stops at ``max_epochs`` times
its source's size and the excess is shared anew by weight among the sources below their
stop, until none is above.

Defined results: null text has size 0 and takes nothing; sources or tables without words
get target 0; rows that repeat a ``doc_id`` are mixed as rows of their own (rows that are
identical in every column used are interchangeable); ties of the key go by ``doc_id``, then size;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WHITE, WORD, free_names, row_key, stored, text_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_SLICE = 2_000
SEED = 20


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, total: float | None = None) -> DataFrame:
    """``source, source_size, n_rows, weight, target`` from one row per source."""
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = per_source.withColumn("weight", weight).withColumn("stop", (F.col("source_size") * max_epochs).cast("double")).withColumn("full", F.lit(False))
    level = stored(level, "mix-sources")
    total = total if total is not None else float(level.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    share, full = 0.0, -1
    while True:
        # a source is full once its share reaches its stop; shares only grow, so this ends
        level = level.withColumn("full", F.col("weight") * F.lit(share) >= F.col("stop")) if full >= 0 else level
        now = level.agg(F.sum(F.col("full").cast("long")), F.sum(F.when(F.col("full"), F.col("stop")).otherwise(0.0)), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight")))).first()
        if now[0] is None or now[0] == full or not now[2]:
            break
        full, share = now[0], max(0.0, total - now[1]) / now[2]
    target = F.when(F.col("full"), F.col("stop")).otherwise(F.least(F.col("weight") * F.lit(share), F.col("stop")))
    return level.select("source", "source_size", "n_rows", "weight", target.alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, total: float | None = None, seed: int = SEED, by_row: bool = False) -> DataFrame:
    """One row per document: ``doc_id, source, key, size, source_size, target, taken``.

    ``by_row`` puts the ``row`` key beside them and into the random key, so that rows without an id, or with the same one, are
    spread over the order like any others.
    """
    own = [row_key(docs).alias("row")] if by_row else []
    rows = stored(docs.select("doc_id", "source", n_words(text_of()).alias("size"), *own), "mix-sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = source_targets(per_source, weights, max_epochs, total)
    targets = targets.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("n_rows") / ROWS_PER_SLICE))).withColumn("budget", F.round("target").cast("long"))
    key = F.md5(F.concat_ws(":", F.lit(seed), "doc_id", "size", *[F.hex("row")] * by_row).cast("binary"))
    rows = rows.withColumn("key", key).withColumn("rank", F.conv(F.substring("key", 1, 8), 16, 10).cast("long"))  # 32 uniform bits, which the slices cut
    rows = rows.join(targets.drop("n_rows", "weight"), rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = rows.withColumn("slice", F.floor(F.col("rank") * F.col("slices") / F.lit(2**32)).cast("int"))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), before.alias("before_slice"))
    inside = W.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["s_source"]) & (rows["slice"] == sums["s_slice"]))
    start = F.col("before_slice") + F.col("inside")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - start))
    taken = F.least(epochs * F.col("size") + part, F.lit(max_epochs) * F.col("size"))
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", taken.cast("long").alias("taken"), *["row"] * by_row)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, total: float | None = None, seed: int = SEED) -> DataFrame:
    """The mixture itself: the columns of ``docs``; a document stands once per whole epoch, and
    the one at the cut once more with only its first words."""
    size, row, take, n, words_of = free_names(docs, "_size", "_row", "_taken", "_n", "_words")
    marked = docs.withColumn(row, row_key(docs)).withColumn(size, n_words(text_of()))
    plan = stored(plan_mix(docs, weights, max_epochs, total, seed, by_row=True).select(F.col("row").alias(row), F.col("taken").alias(take)), "mix-plan")
    repeats = stored(plan.groupBy(row).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).select(row), "mix-repeats")
    taking = plan.filter(F.col(take) > 0)
    joined = marked.join(taking.join(repeats, row, "left_anti"), row)
    if not repeats.isEmpty():
        # copies in every column: it does not matter which of them takes what, so one stands for all, with the number that take as much
        one = marked.join(repeats, row, "left_semi").dropDuplicates([row])
        counts = taking.join(repeats, row, "left_semi").groupBy(row, take).agg(F.count(F.lit(1)).alias(n))
        copies = one.join(counts, row).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), n))).drop(n)
        joined = joined.unionByName(copies.select(*joined.columns))
    whole, part = F.floor(F.col(take) / F.col(size)).cast("int"), F.col(take) % F.col(size)
    lengths = F.concat(F.array_repeat(F.col(size), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    each = joined.withColumn(words_of, F.explode(lengths))
    words = F.filter(F.split("text", WHITE + "+"), lambda w: w != "")
    text = F.when(F.col(words_of) == F.col(size), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col(words_of).cast("int")), " "))
    return each.select(*[text.alias("text") if c == "text" else F.char_length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
