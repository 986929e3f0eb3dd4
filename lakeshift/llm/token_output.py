"""Token ids as Huffman-coded binary blocks.

1. *Tokenise*, once: the ids of every text go to a table in the shared folder.
2. *Count* every id of that table; the counts (one row per id of the vocabulary) fix one canonical, length-limited Huffman code.
3. *Encode* each document to bits, deal the documents by ranges of ``doc_id``, sort within a range, and write each range
   as independent blocks of whole documents.

The file format is a folder that any Spark file system can hold: ``codebook`` (``id, length``; canonical, so the
lengths are the code) and ``blocks``, one Parquet row per block: ``part, block, before`` (ids before it in its
part), ``n_ids``, its documents' ids and numbers of ids, the bits (a document begins at a byte), and as checkpoints the bit
offsets of each document's every 64th id.  A block is decoded by table, at all its checkpoints side by side, without any
other block.

The tokenizer never joins characters across white space, so runs between white space are looked up when they come
again (in a memory of about ``MEMORY`` entries per worker).  Where the tokenizer is of the layout that ``Pieces`` knows, a run
is looked up by its words, numerals and punctuation, which recur far more often than runs.

Defined results: null text counts as empty and has only the end id; ``doc_id`` ascends, null first; rows that
repeat an id stand in order of a hash of their text, then their coded ids; an empty table gives an
empty folder and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshift.session import scratch_path

from .common import shuffle_partitions, stored, text_of
from .hashing import hand_back, trim
from .huffman import Code, code_lengths

MAX_BITS = 16
BLOCK_IDS = 1 << 18
MEMORY = 300_000
#: Pieces that the tokenizer gets at once: what it returns for one is many times its ids.
AT_ONCE = 4_096
BLOCKS = "part int, block int, before long, n_ids long, doc_ids array<long>, doc_sizes array<int>, payload binary, checkpoints binary"
CODED = "part int, doc_id long, h long, n int, payload binary, checkpoints binary"
_RUN = re.compile(r"[^\x20\x09-\x0D]+")

#: The normaliser and the splitting pattern of the layout that ``Pieces`` reproduces.
LAYOUT = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Pieces:
    """Splits texts into strings whose ids, one after the other, are the ids of the text.

    For the known layout, texts of printable ASCII and Latin-1 letters (which normalise to themselves but for case) are split
    as the tokenizer would; a run with other characters, or with what may be a special token, stays whole.
    """

    UNSAFE = re.compile(r"[^\x20-\x7E\x09-\x0D\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]|<\|")
    PIECE = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\x20\x09-\x0Da-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")

    def __init__(self, tokenizer):
        # only these two parts: the whole tokenizer as JSON holds its vocabulary and merges once more
        normaliser, splitter = (json.loads(part.__getstate__()) if part is not None else {} for part in (tokenizer.normalizer, tokenizer.pre_tokenizer))
        normalisers = [n["type"] for n in normaliser.get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in splitter.get("pretokenizers", []) if p["type"] == "Split"]
        self.known = (normalisers, splits) == (LAYOUT[0], [LAYOUT[1]])

    def split(self, text: str) -> list[str]:
        if not self.known:
            return _RUN.findall(text)
        if not self.UNSAFE.search(text):
            return self.PIECE.findall(text.lower())
        out = []
        for run in _RUN.findall(text):
            out += [run] if self.UNSAFE.search(run) else self.PIECE.findall(run.lower())
        return out


class Numbers(dict):
    """Numbers pieces from 0 on as they are first asked for; ``new`` lists those that it had not met."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


class Encoder:
    """Texts to ids, with a bounded memory of pieces."""

    def __init__(self, tokenizer: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(tokenizer), end_id
        self.pieces = Pieces(self.tokenizer)
        if self.pieces.known:
            self.table = {c: "".join(s for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))) for c in range(0xDF, 0x100) if c != 0xF7}
        self._forget()

    def _forget(self) -> None:
        self.number = Numbers()
        self.known = 0
        self.ids, self.first, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _ids_of(self, new: list[str]) -> list[list[int]]:
        if not self.pieces.known:
            return self._through_all(new)
        # a piece is normalised and split already: only the model is left to run, on the tokenizer's characters for its bytes
        tokenize, table, unsafe = self.tokenizer.model.tokenize, self.table, self.pieces.UNSAFE.search
        whole = {w: ids for w, ids in zip(slow, self._through_all(slow), strict=True)} if (slow := [w for w in new if unsafe(w)]) else {}
        return [whole[w] if w in whole else [t.id for t in tokenize(w if w.isascii() else w.translate(table))] for w in new]

    def _through_all(self, new: list[str]) -> list[list[int]]:
        got: list[list[int]] = []
        for i in range(0, len(new), AT_ONCE):
            got += [e.ids for e in self.tokenizer.encode_batch_fast(new[i : i + AT_ONCE], add_special_tokens=False)]
        return got

    def _learn(self, new: list[str]) -> None:
        got = self._ids_of(new)
        size = np.fromiter(map(len, got), np.int64, len(got))
        n, total = self.known + len(new), self.used + int(size.sum())
        self.ids, self.first, self.size = self._room(self.ids, total + 1), self._room(self.first, n), self._room(self.size, n)
        self.first[self.known : n] = self.used + np.cumsum(size) - size
        self.size[self.known : n] = size
        self.ids[self.used : total] = np.fromiter(chain.from_iterable(got), np.uint32, total - self.used)
        self.known, self.used = n, total

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text with the end id, and their numbers."""
        if len(self.number) > MEMORY:
            self._forget()
        number, counts, pieces = self.number, [], []
        for text in texts:
            found = self.pieces.split(text or "")
            counts.append(len(found))
            pieces += found
        which = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        if number.new:
            self._learn(number.new)
            number.new = []
        # the end id of each text is one more piece after its own
        counts = np.array(counts, np.int64)
        at = np.cumsum(counts)
        self.ids[self.used] = self.end_id
        first, size = np.insert(self.first[which], at, self.used), np.insert(self.size[which], at, 1)
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(first - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(ends[np.cumsum(counts + 1) - 1], prepend=0)


def _encoder(tokenizer: str, end_id: int) -> Encoder:
    """The encoder of this Python worker: a worker that is used for many tasks keeps what it has looked up.

    Functions come to a worker by value, with globals of their own, so what stays is held by a module of the worker."""
    kept = sys.modules.setdefault("_lakeshift_worker", types.ModuleType("_lakeshift_worker")).__dict__
    if kept.get("encoder_of") != (tokenizer, end_id):
        kept["encoder"], kept["encoder_of"] = Encoder(tokenizer, end_id), (tokenizer, end_id)
    return kept["encoder"]


def _slices(texts: pa.Array, most_bytes: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Bounds of runs of about ``most_bytes``: a run becomes Python strings, the batch that holds it does not."""
    first = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= most_bytes:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _tokenise(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, end_id)
        for batch in batches:
            trim()  # of what stages and batches before have left
            texts = batch.column("text")
            for a, b in _slices(texts):
                ids, sizes = encoder.encode(texts.slice(a, b - a).to_pylist())
                raw = ids.astype("<u4" if len(ids) and ids.max() > 0xFFFF else "<u2")
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                blobs = [raw[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("h").slice(a, b - a), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "h", "n", "ids"])

    return run


def _pieces_of(batches: Iterator[pa.RecordBatch], most_ids: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``most_ids`` ids: the arrays of a step are many times as large as the ids."""
    for batch in batches:
        ends = np.cumsum(batch.column("n").to_numpy().astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most_ids, side="right")))
            yield batch.slice(a, b - a)
            a = b


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    sizes = batch.column("n").to_numpy().astype(np.int64)
    blobs = batch.column("ids").to_pylist()
    if not any(len(b) != 2 * n for b, n in zip(blobs, sizes.tolist(), strict=True)):
        return np.frombuffer(b"".join(blobs), "<u2").astype(np.int64), sizes
    return np.concatenate([np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4").astype(np.int64) for b, n in zip(blobs, sizes.tolist(), strict=True)]), sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hand_back()  # all texts are tokenised
    total = np.zeros(1, np.int64)
    for batch in _pieces_of(batches):
        n = np.bincount(_ids_of(batch)[0], minlength=len(total))
        n[: len(total)] += total
        total = n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])


def _encode(code, bounds: list[int]):
    """Bits of each document, and its part: the number of ``bounds`` that its id is not below (null ids come first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Code(*code.value)
        for batch in _pieces_of(batches):
            data, n_bytes, offsets, lanes = c.encode(*_ids_of(batch))
            at, lane = np.cumsum(n_bytes), np.cumsum(lanes)
            payload = [data[j - i : j].tobytes() for i, j in zip(n_bytes, at, strict=True)]
            checkpoints = [offsets[j - i : j].tobytes() for i, j in zip(lanes, lane, strict=True)]
            docs = batch.column("doc_id")
            part = np.searchsorted(np.array(bounds, np.int64), docs.fill_null(-(2**63)).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), docs, batch.column("h"), batch.column("n"), pa.array(payload, pa.binary()), pa.array(checkpoints, pa.binary())], [f.split()[0] for f in CODED.split(", ")])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, block, before, waiting = -1, 0, 0, 0
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        nonlocal block, before, held, waiting
        docs, sizes, payload, checkpoints = zip(*held, strict=True)
        base = np.cumsum([0, *map(len, payload)])[:-1] * 8
        points = b"".join((np.frombuffer(c, "<u4") + np.uint32(b)).astype("<u4").tobytes() for c, b in zip(checkpoints, base, strict=True))
        row = [part, block, before, waiting, list(docs), list(sizes), b"".join(payload), points]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        block, before, held, waiting = block + 1, before + waiting, [], 0
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part:  # a task may hold several parts, one after the other
                if held:
                    yield flush()
                part, block, before = row["part"], 0, 0
            held.append((row["doc_id"], row["n"], row["payload"], row["checkpoints"]))
            waiting += row["n"]
            if waiting >= BLOCK_IDS:
                yield flush()
    if held:
        yield flush()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None) -> None:
    """Write the ids of all ``docs`` to the folder ``path``."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), text_of().alias("text"))
    tokenised = stored(texts.mapInArrow(_tokenise(tokenizer, end_id), "doc_id long, h long, n int, ids binary"), "tokenised")
    counts = tokenised.select("n", "ids").mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    seen = sorted((r.id, r.n) for r in counts.collect())  # one row per id of the vocabulary
    ids, n = np.array([x for x, _ in seen], np.int64), np.array([x for _, x in seen], np.int64)
    bits = max(MAX_BITS, int(np.ceil(np.log2(max(2, len(ids))))) + 1)
    lengths = code_lengths(n, bits)
    # from Arrow, as rows of Python would start further Python workers in every executor
    spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int32()), "length": pa.array(lengths, pa.int32())})).coalesce(1).write.parquet(f"{path}/codebook")
    code = spark.sparkContext.broadcast((ids, lengths))
    n_parts = parts or shuffle_partitions(spark)
    # the bounds come from the ids alone, so that a sample for ranges does not encode everything twice
    at = [i / n_parts for i in range(1, n_parts)]
    bounds = tokenised.agg(F.percentile_approx("doc_id", at, 100 * n_parts).alias("b")).first()["b"] if at else []
    coded = tokenised.mapInArrow(_encode(code, sorted(set(bounds or []))), CODED).repartition(n_parts, "part")
    coded.sortWithinPartitions("part", "doc_id", "h", "payload").mapInArrow(_blocks, BLOCKS).write.parquet(f"{path}/blocks")


def _read(code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Code(*code.value)
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                sizes = np.array(row["doc_sizes"], np.int64)
                ids = c.decode(row["payload"], np.frombuffer(row["checkpoints"], "<u4"), sizes)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(ends - sizes + row["before"] + row["part_before"]), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_code(spark: SparkSession, path: str):
    rows = sorted((r.id, r.length) for r in spark.read.parquet(f"{path}/codebook").collect())
    return spark.sparkContext.broadcast((np.array([i for i, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: ``doc_id, start, n_tokens, ids_crc32`` per document."""
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row per part
    n = np.array([totals[part] for part in sorted(totals)], np.int64)
    parts = spark.createDataFrame(pa.table({"part": pa.array(sorted(totals), pa.int32()), "part_before": pa.array(np.cumsum(n) - n)}))
    return blocks.join(F.broadcast(parts), "part").mapInArrow(_read(read_code(spark, path)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a folder below the shared one, and read it back."""
    path = scratch_path(docs.sparkSession, "llm", "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_digests(docs.sparkSession, path)
