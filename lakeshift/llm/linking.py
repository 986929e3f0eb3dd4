"""Links between sets that share an index key, verified exactly, as components.

An index has one row per set: ``node, n, keys, sketch, tokens`` (digest, size, index entries, histogram, sorted 64-bit hashes;
hashes that no other set has may be missing in the last two, but count in the size).
Two sets that share a key are candidates; they link when ``100 * |A & B| >= threshold * |A | B|``.  The sketch counts a set's
hashes in ``CELLS`` parts of their range: the sum of the lesser counts of two sets is never below the number of hashes that
they share, so pairs whose sketches rule a link out need no tokens.

1. Every key has a pivot, its least node.  A node is first verified against the least of its pivots: one pair per node,
   which joins most of any large group of near copies whatever the number of its keys.
2. Then against its other pivots, as far as these are still in another component and the sketches allow a link.
3. The nodes of a pivot that are still in another component than the pivot meet all nodes of that pivot, in blocks of
   nodes of near sizes, so that no task holds a group.  Blocks of ``WIDE`` by ``WIDE`` sketches first return the nodes that may
   link with any other; only these meet with their tokens, in blocks of ``BLOCK`` by ``BLOCK``, which return a spanning forest
   of the links that they found.

No pair of linked sets that share a key is left apart: where a step passes over a pair, the two are in one component already.
Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: Nodes on either side of a verification task: with their sketches, with their tokens.
WIDE, BLOCK = 2048, 256
CELLS = 64


def sketch(tokens: np.ndarray) -> bytes:
    """Histogram of 64-bit hashes."""
    return np.bincount((tokens >> np.uint64(58)).astype(np.int64), minlength=CELLS).astype("<u4").tobytes()


def linked(shared, a, b, threshold: int):
    """Of numbers or arrays of numbers."""
    return 100 * shared >= threshold * (a + b - shared)


def _sketch_pairs(threshold: int):
    """Of pairs of sketches, those that may link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x, y = (np.frombuffer(b"".join(rows[c]), "<u4").reshape(-1, CELLS).astype(np.int64) for c in ("sketch", "pivot_sketch"))
            keep = linked(np.minimum(x, y).sum(axis=1), rows.n, rows.pivot_n, threshold)
            yield rows.loc[keep, ["node", "pivot"]]

    return run


def _sketch_block(threshold: int):
    """The nodes of either side that may link with one of the other side in another component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[rows.side == side] for side in (0, 1))
        x, y = (np.frombuffer(b"".join(part.sketch), "<u4").reshape(-1, CELLS) for part in (left, right))
        small = max(left.n.max(), right.n.max()) < 1 << 16 if len(left) and len(right) else False
        x, y = (np.ascontiguousarray(m.T, np.uint16 if small else np.int64) for m in (x, y))  # a row per cell
        sizes, label = right.n.to_numpy(np.int64), right.label.to_numpy()
        may_left, may_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
        for i, (n, own) in enumerate(zip(left.n, left.label, strict=True)):
            bound = np.minimum(y, x[:, i : i + 1]).sum(axis=0, dtype=x.dtype).astype(np.int64)
            hit = linked(bound, n, sizes, threshold) & (label != own)
            may_left[i] = hit.any()
            may_right |= hit
        return pd.concat([left[may_left], right[may_right]])[["pivot", "step", "side", "node", "n", "label"]]

    return run


def _verify_pairs(threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keep = []
            for x, y, a, b in zip(rows.tokens, rows.pivot_tokens, rows.n, rows.pivot_n, strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), a, b, threshold))
            yield rows.loc[keep, ["node", "pivot"]].rename(columns={"node": "a", "pivot": "b"})

    return run


def _verify_block(threshold: int):
    """Links between the two sides of a block, as a spanning forest over their components."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (y := parent.get(x, x)) != x:
                parent[x] = x = parent.get(y, y)
            return x

        left, right = (list(rows[rows.side == side].itertuples()) for side in (0, 1))
        links = []
        at = 0
        while at < len(left):  # so many left sets that their table of tokens stays small
            end, tokens = at, 0
            while end < len(left) and (end == at or (tokens + left[end].n) * (end - at + 1) <= 64_000_000):
                tokens, end = tokens + left[end].n, end + 1
            part, at = left[at:end], end
            sets = [np.frombuffer(x.tokens, "<u8") for x in part]
            known, where = np.unique(np.concatenate(sets), return_inverse=True)
            holds = np.zeros((len(known), len(part)), np.uint8)
            holds[where, np.repeat(np.arange(len(part)), [len(s) for s in sets])] = 1
            sizes = np.array([x.n for x in part])
            for y in right:
                t = np.frombuffer(y.tokens, "<u8")
                i = np.minimum(np.searchsorted(known, t), len(known) - 1)
                shared = holds[i[known[i] == t]].sum(axis=0, dtype=np.int64)
                for p in np.flatnonzero(100 * shared >= threshold * (sizes + y.n - shared)):
                    x = part[p]
                    if x.label != y.label and (a := root(x.label)) != (b := root(y.label)):
                        parent[a] = b
                        links.append((x.label, y.label))
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def _pairs(pairs: DataFrame, index: DataFrame, threshold: int) -> DataFrame:
    """Of pairs ``node, pivot``, those that link, as ``a, b``."""
    return _beside(pairs, index, "tokens").mapInPandas(_verify_pairs(threshold), "a binary, b binary")


def _beside(pairs: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """Pairs ``node, pivot`` with ``n`` and ``column`` of both."""
    pivots = index.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col(column).alias(f"pivot_{column}"))
    return pairs.join(index.select("node", "n", column), "node").join(pivots, "pivot")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node, label``) after more links, which join nodes or labels."""
    again = stored(components(links), "join-merged")
    known = labels.unionByName(again.join(labels, "node", "left_anti"))
    again = again.select(F.col("node").alias("label"), F.col("label").alias("merged"))
    return stored(known.join(again, "label", "left").select("node", F.coalesce("merged", "label").alias("label")), "join-labels")


def _with_labels(met: DataFrame, labels: DataFrame) -> DataFrame:
    """``met`` with the labels of ``node`` and ``pivot``, and ``other``: are they different?"""
    named = met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label")), "pivot", "left")
    return named.withColumn("pivot_label", F.coalesce("pivot_label", "pivot")).withColumn("other", F.col("label") != F.col("pivot_label"))


def _near_in_size(a: str, b: str, threshold: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def _size_step(n: Column, threshold: int) -> Column:
    """Steps of sizes such that sets whose sizes are near are in one step or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(101.0 / threshold))).cast("int")


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Rows ``pivot, step, side, node, ...`` dealt to blocks ``i, j`` in which every node of side 0 meets every node of side 1."""
    count = lambda side: F.ceil(F.count(F.when(F.col("side") == side, 1)) / size).cast("int")
    sizes = rows.groupBy("pivot", "step").agg(count(0).alias("nl"), count(1).alias("nr")).filter("nl > 0 AND nr > 0")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = F.col("side") == 0
    every = F.sequence(F.lit(0), F.when(left, F.col("nr")).otherwise(F.col("nl")) - 1)
    both = rows.join(sizes, ["pivot", "step"]).withColumn("every", F.explode(every))
    both = both.withColumn("i", F.when(left, own("nl")).otherwise(F.col("every"))).withColumn("j", F.when(left, F.col("every")).otherwise(own("nr")))
    return both.drop("nl", "nr", "every")


def _blocks(met: DataFrame, labels: DataFrame, index: DataFrame, threshold: int) -> DataFrame:
    """Links between nodes of a pivot, some of which are in another component than the pivot: ``a, b`` of labels."""
    named = _with_labels(met, labels).select("node", "n", "pivot", "label", "other").withColumn("step", _size_step(F.col("n"), threshold))
    at = F.col("step")
    # a node of another component meets its own step of sizes and both neighbouring steps
    left = named.filter("other").withColumn("step", F.explode(F.array(at - 1, at, at + 1))).withColumn("side", F.lit(0))
    rows = left.unionByName(named.withColumn("side", F.lit(1))).drop("other")
    meet = ["pivot", "step", "i", "j"]
    wide = _dealt(rows, WIDE).join(index.select("node", "sketch"), "node").groupBy(*meet)
    may = stored(wide.applyInPandas(_sketch_block(threshold), "pivot binary, step int, side int, node binary, n long, label binary").distinct(), "join-may")
    both = _dealt(may, BLOCK).join(index.select("node", "tokens"), "node")
    return both.groupBy(*meet).applyInPandas(_verify_block(threshold), "a binary, b binary").distinct()


def link_nodes(index: DataFrame, threshold: int) -> DataFrame:
    """``node, label`` of every node that links with another."""
    entries = index.select("node", "n", F.explode("keys").alias("key"))
    pivots = entries.groupBy("key").agg(F.min(F.struct("node", "n")).alias("p"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = entries.join(pivots.select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "key")
    met = stored(met.select("node", "n", "pivot", "pivot_n").distinct(), "join-met")
    apart = met.filter(F.col("node") != F.col("pivot")).filter(_near_in_size("n", "pivot_n", threshold)).select("node", "pivot")
    labels = stored(components(_pairs(apart.groupBy("node").agg(F.min("pivot").alias("pivot")), index, threshold)), "join-labels")
    rest = _beside(_with_labels(apart, labels).filter("other").select("node", "pivot"), index, "sketch")
    rest = stored(rest.mapInPandas(_sketch_pairs(threshold), "node binary, pivot binary"), "join-rest")
    if not rest.isEmpty():
        links = _pairs(rest, index, threshold)
        name = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        links = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
        links = stored(links.distinct(), "join-links")
        if not links.isEmpty():
            labels = _merged(labels, links)
    more = stored(_blocks(met.select("node", "n", "pivot"), labels, index, threshold), "join-more")
    return labels if more.isEmpty() else _merged(labels, more)
