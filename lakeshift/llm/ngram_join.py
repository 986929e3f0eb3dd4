"""N-gram Jaccard self-join by token-combination prefixes, exact, with its connected components.

A document's set holds the distinct ``k``-word shingles of its whole text (with fewer words, the whole
sequence as one).  Two documents link when ``100 * |A & B| >= threshold * |A | B|``.

1. *Profile.*  One pass makes each set's size and 128-bit digest.  Documents with the same digest have the
   same set; they are one node from here on, so a group of copies, however large, costs one node.
2. *Document frequency, exact.*  Texts are dealt to chunks by id; a chunk sends the hashes of its
   tokens to shards of the hash range, as one sorted array per (chunk, shard).  A shard counts its
   tokens and returns to each chunk those it holds that occur in two documents or more.  Tokens that
   occur once never come back: they cannot link anything.
3. *Index.*  A set's tokens are ordered by (frequency, hash).  If ``|A| = n``, any partner shares at
   least ``need = ceil(n * threshold / 100)`` tokens, hence at least ``j`` of the first ``n - need + j``.
   A token in at most ``RARE`` documents is indexed alone.  More frequent tokens are
   indexed in combinations of two, from prefixes that are longer for it:

   * sets below ``LONG / (threshold / 100)`` tokens: every pair of frequent tokens among the first ``n - need + 2``;
   * sets of ``LONG`` tokens or more: neighbouring pairs of frequent tokens in a prefix of about three times the
     length, so the index stays linear in the text.  (Two linked sets lack at most ``n - need`` tokens of
     each other.  Merged in order, so many shared tokens have somewhere two with none of the
     others between; these are neighbours in both.)

   Linked sets differ in size by at most the threshold, so any two have one of these schemes in
   common.  If the first token that they share is rare they meet under it; otherwise all that they share
   is frequent, and they meet under a combination.
4. *Verify.*  Nodes that share an index entry are candidates; ``linking`` verifies them on their full sets.

Per document: ``doc_id, n_shingles, component_id`` (least id reachable by links, itself included).

Defined results: null or wordless text has an empty set and links with nothing; null ids stand for themselves
(an all-null component has the id null); rows that repeat an id are returned as often as they come; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import free_names, stored, text_key, text_of
from .linking import link_nodes, sketch

#: A token in at most so many sets is indexed alone.
RARE = 64
#: From so many shingles on, neighbouring frequent tokens are combined instead of all pairs.
LONG = 30
#: Tokens of a chunk of documents, and of a shard of the hash range.
CHUNK_TOKENS, SHARD_TOKENS = 1_500_000, 4_000_000
#: Bits of the filter that ``without`` broadcasts: at most ``FILTER_BITS / 64`` rows of two longs.
FILTER_BITS = 1 << 26
_U = np.uint64


def _needed(n: int, threshold: int) -> int:
    return (threshold * n + 99) // 100


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for i, s in hashing.shingle_sets(batch.column("text"), k):
                sizes[i] = len(s)
                nodes[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
            keys = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(sizes), pa.array(nodes, pa.binary())], [*keys, "n_shingles", "node"])

    return run


def _distinct_sets(docs: pa.Table, right: pa.Table, k: int):
    """Sets of the documents that stand for a node in this chunk: ``(node, sorted hashes)``."""
    wanted = set(right.column("node").drop_null().to_pylist())
    for _, s in hashing.shingle_sets(docs.column("text"), k):
        if len(s) and (node := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) in wanted:
            wanted.discard(node)
            yield node, s


def _shard_of(tokens: np.ndarray, shards: int) -> np.ndarray:
    return ((tokens >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def sent(chunk: int, sets: list[np.ndarray], shards: int) -> pa.Table:
    """The tokens of a chunk's sets, a row per shard: ``shard, chunk, tokens``."""
    tokens = np.sort(np.concatenate(sets)) if sets else np.zeros(0, _U)
    cuts = np.searchsorted(_shard_of(tokens, shards), np.arange(shards + 1))
    low = (tokens & _U(0xFFFFFFFF)).astype("<u4")
    full = [i for i in range(shards) if cuts[i] < cuts[i + 1]]
    return pa.table({"shard": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()), "tokens": pa.array([low[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary())})


def _send(k: int, shards: int):
    def run(key, docs: pa.Table, nodes: pa.Table) -> pa.Table:
        return sent(key[0].as_py(), [s for _, s in _distinct_sets(docs, nodes, k)], shards)

    return run


def count_shard(blobs: pa.Table) -> pa.Table:
    """Of one shard: to each chunk, its tokens that two or more sets hold, with their frequency.

    Tokens are told apart by 32 bits and their shard; where two tokens agree in these, both count as
    more frequent, in every set alike, which the proof allows."""
    arrays = [np.frombuffer(b, "<u4") for b in blobs.column("tokens").to_pylist()]
    every = np.sort(np.concatenate(arrays))
    again = np.concatenate([[False], every[1:] == every[:-1], [False]])
    first, last = np.flatnonzero(again[1:] & ~again[:-1]), np.flatnonzero(again[:-1] & ~again[1:])
    seen, n = every[first], (last - first + 1).astype("<u4")
    del every, again, first, last
    out = []
    for a in arrays:
        a = hashing.distinct(a)
        at = np.searchsorted(seen, a)
        at = at[(at < len(seen)) & (seen[np.minimum(at, len(seen) - 1)] == a)] if len(seen) else at[:0]
        out.append((seen[at].tobytes(), n[at].tobytes()))
    return pa.table({"chunk": blobs.column("chunk"), "shard": blobs.column("shard"), "tokens": pa.array([x for x, _ in out], pa.binary()), "n": pa.array([x for _, x in out], pa.binary())})


def _keys(tokens: np.ndarray, df: np.ndarray, threshold: int) -> np.ndarray:
    """Index entries of a set; ``df`` is 1 where a token occurs in no other set."""
    n = len(tokens)
    miss = n - _needed(n, threshold)
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    head = slice(0, miss + 1)
    keys = [hashing.mix(tokens[head][(df[head] > 1) & (df[head] <= RARE)])]
    if n * threshold < LONG * 100:
        f = tokens[: miss + 2][df[: miss + 2] > RARE]
        i, j = np.triu_indices(len(f), 1)
        keys.append(hashing.mix(f[i] * _U(0x9E3779B97F4A7C15) + f[j]))
    if n >= LONG:
        largest = n * 100 // threshold
        reach = miss + (miss + largest - _needed(largest, threshold) + 2)
        f = tokens[:reach][df[:reach] > RARE]
        keys.append(hashing.mix((f[:-1] * _U(0xD1342543DE82EF95) + f[1:]) ^ _U(0x5DEECE66D)))
    return np.unique(np.concatenate(keys))


def frequencies(back: pa.Table, shards: int) -> Callable[[np.ndarray], np.ndarray]:
    """From what the shards returned to a chunk, in how many sets each token of a set occurs."""
    high, n = [], []
    for shard, t, f in zip(back.column("shard").to_pylist(), back.column("tokens").to_pylist(), back.column("n").to_pylist(), strict=True):
        t = np.frombuffer(t, "<u4").astype(_U)
        high.append((_U(shard) << _U(32)) | t)
        n.append(np.frombuffer(f, "<u4"))
    many = np.concatenate(high) if high else np.zeros(0, _U)
    freq = np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)
    order = np.argsort(many)
    many, freq = many[order], freq[order]

    def of(s: np.ndarray) -> np.ndarray:
        short = (_shard_of(s, shards).astype(_U) << _U(32)) | (s & _U(0xFFFFFFFF))
        df = np.ones(len(s), np.int64)
        if len(many):
            at = np.minimum(np.searchsorted(many, short), len(many) - 1)
            hit = many[at] == short
            df[hit] = freq[at[hit]]
        return df

    return of


def _index(k: int, shards: int, threshold: int):
    def run(key, docs: pa.Table, right: pa.Table) -> pa.Table:
        frequency = frequencies(right.filter(right.column("shard").is_valid()), shards)
        rows = []
        for node, s in _distinct_sets(docs, right, k):
            keys = _keys(s, frequency(s), threshold)
            if len(keys):
                rows.append((node, len(s), keys.astype(np.int64), sketch(s), s.astype("<u8").tobytes()))
        return pa.table({"node": pa.array([r[0] for r in rows], pa.binary()), "n": pa.array([r[1] for r in rows], pa.int64()), "keys": pa.array([r[2] for r in rows], pa.list_(pa.int64())), "sketch": pa.array([r[3] for r in rows], pa.binary()), "tokens": pa.array([r[4] for r in rows], pa.binary())})

    return run


def _search(docs: DataFrame, nodes: DataFrame, k: int, threshold: int, total: int) -> DataFrame:
    """The index: ``node, n, keys, sketch, tokens`` of every set that may link."""
    chunks = max(1, -(-total // CHUNK_TOKENS))
    shards = max(1, -(-total // SHARD_TOKENS))
    spread = lambda df: df.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    texts = spread(docs).select("chunk", "text").groupBy("chunk")
    stand = spread(nodes).select("chunk", "node")
    sent = texts.cogroup(stand.groupBy("chunk")).applyInArrow(_send(k, shards), "shard int, chunk int, tokens binary")
    back = sent.groupBy("shard").applyInArrow(count_shard, "chunk int, shard int, tokens binary, n binary")
    right = back.select("chunk", F.lit(None).cast("binary").alias("node"), "shard", "tokens", "n")
    right = right.unionByName(stand, allowMissingColumns=True)
    return texts.cogroup(right.groupBy("chunk")).applyInArrow(_index(k, shards, threshold), "node binary, n long, keys array<long>, sketch binary, tokens binary")


def _groups(docs: DataFrame, k: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Of rows ``doc_id, text`` and more: every row with its ``n_shingles, node`` instead of the text; and ``node, doc_id, label`` of every node."""
    if threshold < 75:
        raise ValueError("the index of long sets is exact from a threshold of 75 per cent on")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    profile = stored(docs.mapInArrow(_profile(k), f"{keys}, n_shingles long, node binary"), "join-profile")
    nodes = profile.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"))
    nodes = stored(nodes, "join-nodes")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    index = stored(_search(docs, nodes, k, threshold, total), "join-index")
    labels = link_nodes(index, threshold)
    return profile, nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))


def jaccard_components(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``; ``threshold`` in per cent."""
    profile, named = _groups(docs.select("doc_id", text_of().alias("text")), k, threshold)
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "label").select("node", "component_id")
    out = profile.join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _bit(*key: Column) -> tuple[Column, Column]:
    """Place of a key in the filter: the number of its word, and the word with its bit set."""
    at = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))


def without(docs: DataFrame, going: DataFrame, same: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows that agree with one of ``going``: ``same`` has a value of ``docs`` for each of its columns.

    A filter of bounded size shows which rows may be named. Only these move to the exact anti-join; the fuller the filter, the more
    of the others move with them, with the same result."""
    w, b = free_names(docs, "_word", "_bits")
    kinds = dict(going.dtypes)
    word, bit = _bit(*[F.col(c) for c in same])
    words = F.broadcast(going.select(word.alias(w), bit.alias(b)).groupBy(w).agg(F.bit_or(b).alias(b)))
    word, bit = _bit(*[value.cast(kinds[c]) for c, value in same.items()])
    may = (word == F.col(w)) & (F.col(b).bitwiseAND(bit) != 0)
    agree = reduce(Column.__and__, [value.eqNullSafe(F.col(c)) for c, value in same.items()])
    return docs.join(words, may, "left_anti").unionByName(docs.join(words, may, "left_semi").join(going.select(*same), agree, "left_anti"))


def keep_one(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one row of every group: of those with the least id (null last), the least by text.

    Rows are told apart by id and text, so rows without an id, or with the same id and other texts, are documents of their own
    that stay or go with their own group.  Rows without words are in no group: all of them stay.
    """
    profile, named = _groups(docs.select("doc_id", text_key().alias("digest"), text_of().alias("text")), k, threshold)
    copies = profile.filter("n_shingles > 0").groupBy("doc_id", "digest", "node").agg(F.count(F.lit(1)).alias("n"))
    rows = stored(copies.join(named.select("node", "label"), "node").select("doc_id", "digest", "label", "n"), "join-groups")
    per_id = rows.groupBy("label", "doc_id").agg(F.sum("n").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("best")
    groups = per_id.groupBy("label").agg(best, F.sum("n").alias("all")).filter("all > 1").select("label", F.col("best.doc_id").alias("least"), F.col("best.n").alias("n_least"))
    first = F.col("doc_id").eqNullSafe(F.col("least"))
    # stored, so that their sizes are known when the joins are planned
    i, d, l, f, t, r = free_names(docs, "_id", "_digest", "_label", "_first", "_text", "_row")
    going = rows.select("doc_id", "digest", "label").join(groups, "label").filter(~first | (F.col("n_least") > 1))
    going = stored(going.select(F.col("doc_id").alias(i), F.col("digest").alias(d), F.col("label").alias(l), first.alias(f)), "join-dropped")
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (text_key() == F.col(d))
    out = without(docs, going, {i: F.col("doc_id"), d: text_key()})
    again = going.filter(F.col(f))
    if again.isEmpty():
        return out
    least = F.min(F.struct(text_of().alias(t), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(r))).alias("best")
    again = docs.join(again, same).groupBy(l).agg(least)
    return out.unionByName(again.select(f"best.{r}.*"))
