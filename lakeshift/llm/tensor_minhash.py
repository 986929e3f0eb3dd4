"""Near duplicates by tensored MinHash banding, verified exactly, with their connected components.

A document's set holds the distinct ``k``-word shingles of its whole text (with fewer words, the whole sequence as one).
Two documents link when ``100 * |A & B| >= threshold * |A | B|``.

Plain banding with ``T`` tables of ``2 r`` minhashes computes ``2 r T`` of them.  Here two small collections hold ``m`` bands of
``r`` minhashes each, and every pair of a band of the one with a band of the other is the key of a table: ``m * m``
tables from ``2 r m`` minhashes (``BANDS`` = 14 and ``ROWS`` = 2: 196 tables from 56 minhashes instead of 784).
Sets of similarity ``s`` share a key unless one of the collections has no common band: they are missed with a probability of at most
``2 (1 - s**r)**m``, 1.3e-6 at ``s`` = 0.8 and 2e-10 at 0.9.  Lower thresholds need more bands; below 0.7 the call raises.

1. *Profile.*  One pass makes each set's size, its 128-bit digest and its bands.  Documents with the same digest have the same
   set; they are one node from here on, so a group of copies, however large, costs one node.
2. *Bands.*  A band that no other node shares cannot be part of a shared key.  These go first, so that only nodes with a
   shared band in either collection make keys, from shared bands alone: a document that is like no other makes none.
3. *Tables.*  The remaining bands of a node are combined, one of either collection, to its keys.
4. *Sets in common.*  The whole texts of nodes with a shared key are shingled again, and the hashes counted over all of them, by
   shards of the hash range.  A link needs ``threshold`` per cent of either set in the other, so a node of which fewer hashes
   occur in any other set links with nothing and goes.  Of a large group of copies that differ too much, each with changes
   of its own, these are the most; left in, each would be compared with all of the group.  The others keep the hashes that
   another set has, too, so that their histograms rule out more.
5. *Verify.*  ``linking`` confirms links on full sets.

Per document: ``doc_id, n_shingles, component_id`` (least id reachable by links, itself included), ``kept`` (is it that one?).

Defined results: null or wordless text has an empty set and links with nothing; null ids stand for themselves (an all-null
component has the id null, and its rows are kept); rows that repeat an id are returned as often as they come, all of them
kept or none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing, ngram_join
from .common import stored, text_of
from .linking import link_nodes, sketch
from .ngram_join import count_shard, frequencies, sent

#: Bands of a collection, and minhashes of a band.
BANDS, ROWS = 14, 2
_U = np.uint64


def _multipliers() -> np.ndarray:
    """One odd 64-bit factor per minhash: ``x -> x * factor`` permutes the (already mixed) shingle hashes."""
    return hashing.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def bands_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bands of the sets that begin at ``starts`` in ``hashes``: one row per set, the first collection first."""
    out = np.empty((len(starts), 2 * BANDS), np.uint64)
    for band, factors in enumerate(_multipliers().reshape(-1, ROWS)):
        key = np.full(len(starts), band, np.uint64)
        for factor in factors:
            key = hashing.mix(key * _U(0xD1342543DE82EF95) + np.minimum.reduceat(hashes * factor, starts))
        out[:, band] = key
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, bands = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows
            for first, data, starts, ends in hashing.batches(batch.column("text")):
                of, hashes = hashing.shingles(*hashing.words(data, starts, ends), k)
                cuts = np.searchsorted(of, np.arange(len(starts) + 1))
                full = np.flatnonzero(cuts[:-1] < cuts[1:])
                if not len(full):
                    continue
                for i, row in zip(full.tolist(), bands_of(hashes, cuts[full]).astype(np.int64), strict=True):
                    s = hashing.distinct(hashes[cuts[i] : cuts[i + 1]])
                    sizes[first + i], nodes[first + i], bands[first + i] = len(s), _digest(s), row
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(sizes), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h", "n_shingles", "node", "bands"]
            )

    return run


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in hashing.shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(len, sets), pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "n", "tokens"])

    return run


def _send(shards: int):
    def run(key: tuple[pa.Scalar, ...], sets: pa.Table) -> pa.Table:
        return sent(key[0].as_py(), [np.frombuffer(t, "<u8") for t in sets.column("tokens").to_pylist()], shards)

    return run


def _held_by_others(shards: int, threshold: int):
    def run(key, sets: pa.Table, back: pa.Table) -> pa.Table:
        frequency = frequencies(back, shards)
        rows = []
        for node, n, tokens in zip(*(sets.column(c).to_pylist() for c in ("node", "n", "tokens")), strict=True):
            s = np.frombuffer(tokens, "<u8")
            held = s[frequency(s) > 1]
            if 100 * len(held) >= threshold * n:
                rows.append((node, n, sketch(held), held.tobytes()))
        kinds = {"node": pa.binary(), "n": pa.int64(), "sketch": pa.binary(), "tokens": pa.binary()}
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())})

    return run


def _in_common(sets: DataFrame, threshold: int) -> DataFrame:
    """``node, n, sketch, tokens`` of those ``node, n, tokens`` that may link with another, with the tokens that others have, too."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    chunks, shards = max(1, -(-total // ngram_join.CHUNK_TOKENS)), max(1, -(-total // ngram_join.SHARD_TOKENS))
    dealt = sets.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int")).groupBy("chunk")
    back = dealt.applyInArrow(_send(shards), "shard int, chunk int, tokens binary").groupBy("shard").applyInArrow(count_shard, "chunk int, shard int, tokens binary, n binary")
    return dealt.cogroup(back.groupBy("chunk")).applyInArrow(_held_by_others(shards, threshold), "node binary, n long, sketch binary, tokens binary")


def _keys(nodes: DataFrame) -> DataFrame:
    """``node, keys`` of every node that shares a band of either collection with another node."""
    bands = nodes.select("node", F.posexplode("bands").alias("slot", "band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1").select("band")
    sides = [F.collect_list(F.when(side, F.col("band"))).alias(name) for name, side in (("one", F.col("slot") < BANDS), ("two", F.col("slot") >= BANDS))]
    held = bands.join(shared, "band", "left_semi").groupBy("node").agg(*sides)  # at most BANDS on either side
    table = F.flatten(F.transform("one", lambda a: F.transform("two", lambda b: F.xxhash64(a, b))))
    return held.filter((F.size("one") > 0) & (F.size("two") > 0)).select("node", table.alias("keys"))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``; ``threshold`` in per cent."""
    if threshold < 70:
        raise ValueError("the bands are made for thresholds of 70 per cent and more")
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    profile = stored(texts.mapInArrow(_profile(k), "doc_id long, h long, n_shingles long, node binary, bands array<long>"), "tensor-profile")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "bands")).alias("best")
    nodes = profile.filter("node is not null").groupBy("node").agg(best).select("node", "best.doc_id", "best.h", "best.bands")
    nodes = stored(nodes, "tensor-nodes")
    keyed = stored(_keys(nodes), "tensor-keys")
    # the texts that stand for a node with keys; rows that repeat id and text give the same set
    wanted = nodes.join(keyed.select("node"), "node").select("node", F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    whole = texts.join(wanted, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    sets = stored(whole.mapInArrow(_tokens(k), "node binary, n long, tokens binary").dropDuplicates(["node"]), "tensor-sets")
    index = stored(_in_common(sets, threshold).join(keyed, "node"), "tensor-index")
    labels = link_nodes(index, threshold)
    named = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "label").select("node", "least")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    out = profile.drop("bands").join(named, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
