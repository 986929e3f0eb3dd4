"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short, a document may be long, so their Jaccard similarity says nothing; what counts is the
share of the item's shingles that the document holds.  Words are runs of letters and digits
(case folded, all other ASCII parts them, so punctuation does not hide a copy); a
shingle is ``k`` words, of an item with fewer words the whole item, which a document is then searched for at the item's own length.

1. *Size partitions.*  Items are partitioned by the power of two of their number of shingles.  The sketch of
   an item is its ``b`` least shingle hashes (a bottom-b MinHash), where ``b`` is one more than
   the number of shingles that an item of its size may lack.  A document that contains at least
   ``threshold`` of the item therefore holds one of them: the search misses nothing.  Documents
   with fewer shingles than the least item of a partition needs skip that partition.
2. *Search.*  The sketches are an index from hash to item.  A document's distinct shingle hashes are looked up
   in it; a hit makes (document, item) a candidate.
3. *Verify.*  Of each candidate, the item's shingles in the document are counted exactly.

The items are the stated query set: they go to the tasks in blocks of at most ``BLOCK_CHARS`` characters, each
block against all documents, so what is broadcast has a fixed bound however many items there are.  Documents
never move: each block is one map over the whole texts, with no shuffle.

Defined results: null or wordless items and documents match nothing; repeated items or documents give repeated
rows; empty tables give no rows; an item of fewer words than ``k`` is found wherever its words stand together; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import free_names, stored, text_key, text_of
from .ngram_join import without

BLOCK_CHARS = 16_000_000
SCHEMA = "doc_id long, item_id long, n_item_shingles int, n_shared int, containment double"


class ItemIndex:
    """The sketches and whole shingle sets of items of at least ``k`` words (texts in lower case)."""

    def __init__(self, item_ids: list, texts: list[str], k: int, threshold: float):
        self.ids, self.sets, sketch, of = [], [], [], []
        for i, s in hashing.shingle_sets(pa.array(texts, pa.large_string()), k, hashing.PUNCTUATION):
            if not len(s):
                continue
            b = len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1
            sketch.append(s[:b])
            of.append(np.full(b, len(self.ids)))
            self.ids.append(item_ids[i])
            self.sets.append(s)
        self.need = np.array([int(np.ceil(threshold * len(s) - 1e-9)) for s in self.sets], np.int64)
        sizes = np.array([len(s) for s in self.sets], np.int64)
        of = np.concatenate(of) if of else np.zeros(0, np.int64)
        hashes = np.concatenate(sketch) if sketch else np.zeros(0, np.uint64)
        # per size partition: least size that a document needs, hashes in order, their items, and a bitmap over their low bits
        self.parts = []
        for p in np.unique(np.log2(sizes[of]).astype(int)) if len(of) else []:
            mine = np.flatnonzero(np.log2(sizes[of]).astype(int) == p)
            mine = mine[np.argsort(hashes[mine], kind="stable")]
            bits = np.zeros(1 << 20, bool)
            bits[(hashes[mine] & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.parts.append((int(self.need[of[mine]].min()), hashes[mine], of[mine], bits))

    def search(self, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(item number, its shingles, shared)`` of the items that ``doc`` (sorted hashes) contains."""
        for least, hashes, of, bits in self.parts:
            if len(doc) < least:
                continue
            maybe = doc[bits[(doc & np.uint64(0xFFFFF)).astype(np.int64)]]
            a, b = np.searchsorted(hashes, maybe), np.searchsorted(hashes, maybe, side="right")
            for item in sorted({int(of[i]) for x, y in zip(a[a < b], b[a < b], strict=True) for i in range(x, y)}):
                s = self.sets[item]
                at = np.minimum(np.searchsorted(doc, s), len(doc) - 1)
                if (shared := int((doc[at] == s).sum())) >= self.need[item]:
                    yield item, len(s), shared


def _by_length(ids: list, texts: list[str], k: int, threshold: float) -> list[tuple[int, dict]]:
    """``(m, index)`` for every length of shingle ``m`` that the items need: ``k`` words, or all words of a shorter item.

    An index is given as its plain arrays, which a task can read without this package.
    """
    size = np.zeros(len(texts), np.int64)
    for first, data, starts, ends in hashing.batches(pa.array(texts, pa.large_string())):
        _, a, b = hashing.words(data, starts, ends, hashing.PUNCTUATION)
        size[first : first + len(a)] = np.minimum(b - a, k)
    lengths = [int(m) for m in np.unique(size[size > 0])]
    mine = lambda values, m: [x for x, n in zip(values, size, strict=True) if n == m]
    return [(m, vars(ItemIndex(mine(ids, m), mine(texts, m), m, threshold))) for m in lengths]


def _scan(blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = []
        for m, state in blocks.value:
            items = ItemIndex.__new__(ItemIndex)
            vars(items).update(state)
            indexes.append((m, items))
        for batch in batches:
            texts = batch.column("text")
            rows, out = [], []
            for m, items in indexes:
                for i, doc in hashing.shingle_sets(texts, m, hashing.PUNCTUATION):
                    for item, size, shared in items.search(doc):
                        rows.append(i)
                        out.append((items.ids[item], size, shared, shared / size))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64())
            keys = [c for c in batch.schema.names if c != "text"]
            found = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keys] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(found, [*keys, "item_id", "n_item_shingles", "n_shared", "containment"])

    return run


def find_contamination(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, item_id, n_item_shingles, n_shared, containment`` of every document and item with a containment of ``threshold`` or more."""
    return _find(docs.select("doc_id", F.lower(text_of()).alias("text")), items, k, threshold, SCHEMA)


def _find(texts: DataFrame, items: DataFrame, k: int, threshold: float, schema: str) -> DataFrame:
    """The same of lower-cased ``texts``, whose other columns are returned as they are."""
    spark = texts.sparkSession
    # items and documents are put in lower case by the same function
    items = items.select("item_id", F.lower(text_of()).alias("text")).filter(F.char_length("text") > 0)
    chars = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-chars // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    found = []
    for b in range(n_blocks):
        rows = items.filter(block == b).collect()  # a block of the query set: bounded
        index = _by_length([r.item_id for r in rows], [r.text for r in rows], k, threshold)
        if index:
            found.append(texts.mapInArrow(_scan(spark.sparkContext.broadcast(index)), schema))
    if not found:
        return spark.range(0).selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in map(str.split, schema.split(", "))])
    return reduce(DataFrame.unionByName, found)


def remove_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that contain no item, each by its own text."""
    texts = docs.select("doc_id", text_key().alias("digest"), F.lower(text_of()).alias("text"))
    found = _find(texts, items, k, threshold, SCHEMA.replace("doc_id long", "doc_id long, digest string"))
    # stored, as the filter and the exact join both read it
    doc, digest = free_names(docs, "_bad", "_digest")
    bad = stored(found.select(F.col("doc_id").alias(doc), F.col("digest").alias(digest)).distinct(), "contaminated")
    return without(docs, bad, {doc: F.col("doc_id"), digest: text_key()})
