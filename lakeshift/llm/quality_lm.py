"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, of order ``ORDER``: an n-gram is exactly its bytes packed into a 64-bit key, its context is
the key shifted by a byte and its suffix the key masked, so every count, context and back-off is an equi-join
on integers, sharded over the cluster.

1. *Pack.*  Texts are dealt to chunks by a hash of ``doc_id``, packed as compressed Arrow batches.
2. *Count.*  A chunk meets its labels, counts the n-grams of its trusted documents (label quality 1; every such
   document, a tenth held back for thresholds) and lists the distinct n-grams, of all orders, of all its documents.
3. *Model.*  Counts are added up per n-gram.  Lower orders count distinct left neighbours.  Each order has
   three discounts from its counts of counts; probabilities are interpolated from order 1 up, by joins on context and suffix.
4. *Score.*  The chunks' n-grams meet the model in shards of the key; each chunk gets back the
   probabilities and back-off weights it asked for and scores its documents: perplexity per byte.
   What moves per chunk is its distinct n-grams, which is far less than its text.
5. *Threshold.*  Short texts vary more, so a document's excess over its language's median is measured in
   units of ``FLOOR + SPREAD / sqrt(bytes)``.  A language's threshold is ``MARGIN`` times the ``QUANTILE`` of
   its held-back trusted documents' excess, at least ``LEAST`` units; a document above it is rejected.

Defined results: null and empty texts have perplexity 1 and are kept; a null language is a language of its own;
languages without trusted documents use the threshold of all languages together; without trusted documents nothing is
rejected; labels that disagree on an id count as not trusted; rows that repeat an id are scored as rows; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, stored, text_key, text_of
from .hashing import distinct
from .ngram_join import without

ORDER = 5
CHUNK_BYTES = 24_000_000
#: Bytes of rows that a task packs at once; packing holds them several times.
PACK_BYTES = 16_000_000
SHARD_BYTES = 400_000_000
QUANTILE, MARGIN, LEAST = 0.99, 1.5, 3.0
FLOOR, SPREAD = 0.02, 1.2
HELD_BACK = 10
#: A prime; keys are dealt to shards by their remainder.
SPREAD_BY = 1_000_003
_U = np.uint64


def _pack():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            chunk = rows.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            rows, chunk = rows.take(pa.array(order)).drop_columns(["chunk"]), chunk[order]
            for c, a in zip(*np.unique(chunk, return_index=True), strict=True):
                part = rows.slice(int(a), int(np.searchsorted(chunk, c, side="right") - a))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                    w.write_table(part.combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "docs"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > PACK_BYTES:
                yield from flush()
                held, size = [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield from flush()

    return run


def _unpack(blobs: pa.Table) -> Iterator[pa.Table]:
    for blob in blobs.column("docs").to_pylist():
        yield pa.ipc.open_stream(blob).read_all()


def byte_keys(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each byte, text after text, and each text's bytes; a text begins after line breaks."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    pad = b"\n" * (order - 1)
    data = np.frombuffer(b"".join(x for r in raw for x in (pad, r)), np.uint8)
    keys = np.zeros(max(0, len(data) - order + 1), _U)
    for j in range(order):
        keys = (keys << _U(8)) | data[j : len(data) - order + 1 + j]
    # of each text, the n-grams that end within it
    first = np.cumsum(sizes + order - 1) - (sizes + order - 1)
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return keys[at], sizes


def _text_runs(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _tagged(keys: np.ndarray, n: int) -> np.ndarray:
    return keys | (_U(n) << _U(56))


def _all_orders(keys: np.ndarray, order: int) -> np.ndarray:
    """The distinct n-grams of all orders in ``keys`` and the empty context, tagged and ascending; contexts of a text's first bytes too."""
    out = [np.zeros(1, _U), _tagged(keys, order)]
    for n in range(order - 1, 0, -1):
        keys = distinct(np.concatenate([keys & _U((1 << 8 * n) - 1), keys >> _U(8)]))
        out.append(_tagged(keys, n))
    return np.sort(np.concatenate(out))


def _squeeze(keys: np.ndarray) -> bytes:
    return pa.compress(np.diff(keys, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(keys) else b""


def _widen(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").reshape(-1).astype(_U), dtype=_U)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys % _U(SPREAD_BY) % _U(shards)).astype(np.int64)


GATHERED = "kind int, shard int, chunk int, size int, keys binary, counts binary"


def _gather(order: int, shards: int):
    """Per chunk: its trusted n-grams with counts (kind 0), and its distinct n-grams of all orders by shard (kind 1)."""

    def run(key, blobs: pa.Table, labels: pa.Table) -> pa.Table:
        trusted = set(labels.column("doc_id").to_pylist())
        seen, counted = [], []
        for docs in _unpack(blobs):
            texts = docs.column("text").to_pylist()
            train = np.array([d in trusted and not h for d, h in zip(docs.column("doc_id").to_pylist(), docs.column("held").to_pylist(), strict=True)], bool)
            for a, b in _text_runs(texts):
                keys, sizes = byte_keys(texts[a:b], order)
                of = np.repeat(train[a:b], sizes)
                seen.append(distinct(keys[~of]))
                counted.append(np.unique(keys[of], return_counts=True))
                seen.append(counted[-1][0])
            if len(seen) > 16:
                seen = [distinct(np.concatenate(seen))]
        rows = []
        chunk = key[0].as_py()
        if counted and sum(len(k) for k, _ in counted):
            keys, where = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([c for _, c in counted])).astype("<u8")
            rows.append((0, 0, chunk, len(keys), _squeeze(keys), n.tobytes()))
        if seen:
            keys = _all_orders(distinct(np.concatenate(seen)), order)
            shard = _shard_of(keys, shards)
            rows += [(1, s, chunk, int((shard == s).sum()), _squeeze(keys[shard == s]), b"") for s in range(shards)]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({f.split()[0]: pa.array(c, t) for f, c, t in zip(GATHERED.split(", "), cols, kinds, strict=True)})

    return run


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(_widen(row["keys"], row["size"]).astype(np.int64)), pa.array(np.frombuffer(row["counts"], "<u8").astype(np.int64))], ["key", "n"])


def _discounts(counts: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney: what counts of 1, 2 and 3 or more give up."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(found)]


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, logp, logg``: tagged n-grams with their log probability and, as contexts, their log back-off weight."""
    level, levels = counts.withColumnRenamed("n", "c"), {}
    for n in range(order, 0, -1):
        if n < order:
            level = level.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("c"))
        levels[n] = level = stored(level, "lm-level")
    lower, out = None, []
    for n in range(1, order + 1):
        by_count = {r.c: r.n for r in levels[n].filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
        d = _discounts(by_count)
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = levels[n].withColumn("off", off).withColumn("context", F.shiftright("key", 8))
        contexts = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("off").alias("left")).withColumn("g", F.col("left") / F.col("total"))
        rows = rows.join(contexts, "context")
        if n == 1:
            below = F.lit(1 / 256)
        else:
            rows = rows.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("below")), "suffix")
            below = F.col("below")
        lower = stored(rows.select("key", ((F.col("c") - F.col("off")) / F.col("total") + F.col("g") * below).alias("p")), "lm-p")
        none = F.lit(None).cast("double")
        out.append(lower.select(F.col("key").bitwiseOR(F.lit(n << 56)).alias("key"), F.log("p").alias("logp"), none.alias("logg")))
        out.append(contexts.select(F.col("context").bitwiseOR(F.lit((n - 1) << 56)).alias("key"), none.alias("logp"), F.log("g").alias("logg")))
    union = out[0]
    for part in out[1:]:
        union = union.unionByName(part)
    return stored(union.groupBy("key").agg(F.max("logp").alias("logp"), F.max("logg").alias("logg")), "lm-model")


def _answer(key, asked: pa.Table, model: pa.Table) -> pa.Table:
    known = model.column("key").to_numpy().astype(_U)
    order = np.argsort(known)
    known = known[order]
    values = [model.column(c).to_numpy(zero_copy_only=False)[order].astype("<f4") for c in ("logp", "logg")]
    rows = []
    for chunk, size, blob in zip(asked.column("chunk").to_pylist(), asked.column("size").to_pylist(), asked.column("keys").to_pylist(), strict=True):
        keys = _widen(blob, size)
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        hit = known[at] == keys if len(known) else np.zeros(size, bool)
        rows.append((chunk, int(hit.sum()), _squeeze(keys[hit]), values[0][at[hit]].tobytes(), values[1][at[hit]].tobytes()))
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("chunk", "size", "keys", "logp", "logg"), cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)})


def _log_probabilities(keys: np.ndarray, known: np.ndarray, logp: np.ndarray, logg: np.ndarray, order: int) -> np.ndarray:
    """Of n-grams of the highest order, backing off where they are unknown."""

    def find(tagged):
        at = np.minimum(np.searchsorted(known, tagged), max(0, len(known) - 1))
        return at, known[at] == tagged if len(known) else np.zeros(len(tagged), bool)

    out = np.full(len(keys), np.log(1 / 256))
    for n in range(1, order + 1):
        part = keys & _U((1 << 8 * n) - 1)
        at, hit = find(_tagged(part >> _U(8), n - 1))
        back = hit & ~np.isnan(logg[at]) if len(known) else hit
        out[back] += logg[at[back]]
        at, hit = find(_tagged(part, n))
        hit = hit & ~np.isnan(logp[at]) if len(known) else hit
        out[hit] = logp[at[hit]]
    return out


def _score(order: int, digests: bool):
    def run(key, blobs: pa.Table, answers: pa.Table) -> pa.Table:
        known = [_widen(b, n) for b, n in zip(answers.column("keys").to_pylist(), answers.column("size").to_pylist(), strict=True)]
        known = np.concatenate(known) if known else np.zeros(0, _U)
        by = np.argsort(known)
        known = known[by]
        logp, logg = (np.concatenate([np.frombuffer(b, "<f4") for b in answers.column(c).to_pylist()] or [np.zeros(0, "<f4")])[by].astype(float) for c in ("logp", "logg"))
        ids, langs, held, sizes, losses, keys_of = [], [], [], [], [], []
        for docs in _unpack(blobs):
            texts = docs.column("text").to_pylist()
            ids += docs.column("doc_id").to_pylist()
            langs += docs.column("lang").to_pylist()
            held += docs.column("held").to_pylist()
            if digests:
                keys_of += [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            for a, b in _text_runs(texts):
                keys, n = byte_keys(texts[a:b], order)
                where, once = pd.factorize(keys)
                loss = -_log_probabilities(once, known, logp, logg, order)[where]
                total = np.concatenate([[0.0], np.cumsum(loss)])
                ends = np.cumsum(n)
                losses.append((total[ends] - total[ends - n]) / np.maximum(n, 1))
                sizes.append(n)
        flat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        out = {"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "held": pa.array(held, pa.bool_()), "n_bytes": pa.array(flat(sizes, np.int64)), "loss": pa.array(flat(losses, float))}
        return pa.table(out | ({"digest": pa.array(keys_of, pa.string())} if digests else {}))

    return run


def score_quality(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, digests: bool = False) -> DataFrame:
    """``doc_id, lang, n_bytes, perplexity, excess, threshold, kept`` per row of ``docs``; with ``digests``, the text's SHA-256 too."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text_of().alias("text"), (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD_BACK)) == 0).alias("held"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks, shards = max(1, -(-total // CHUNK_BYTES)), max(1, -(-total // SHARD_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk")
    packed = rows.select(chunk, "doc_id", "lang", "text", "held").mapInArrow(_pack(), "chunk int, docs binary").groupBy("chunk")
    trusted = stored(labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id", chunk), "lm-trusted")

    gathered = stored(packed.cogroup(trusted.groupBy("chunk")).applyInArrow(_gather(order, shards), GATHERED), "lm-gathered")
    counts = gathered.filter("kind = 0").select("size", "keys", "counts").mapInArrow(_expand, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    model = kneser_ney(counts, order)
    model = model.withColumn("shard", (F.col("key") % SPREAD_BY % shards).cast("int"))
    asked = gathered.filter("kind = 1").select("shard", "chunk", "size", "keys")
    answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_answer, "chunk int, size int, keys binary, logp binary, logg binary")
    scored = packed.cogroup(answers.groupBy("chunk")).applyInArrow(_score(order, digests), "doc_id long, lang string, held boolean, n_bytes long, loss double" + ", digest string" * digests)
    scored = stored(scored, "lm-scored")

    sample = scored.filter("held and n_bytes > 0").join(trusted.select("doc_id"), "doc_id", "left_semi").select("lang", "n_bytes", "loss")
    unit = F.lit(FLOOR) + F.lit(SPREAD) / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    middle = F.percentile_approx("loss", 0.5, 10_000).alias("middle")
    high = F.greatest(F.percentile_approx((F.col("loss") - F.col("middle")) / unit, quantile, 10_000) * margin, F.lit(LEAST)).alias("threshold")
    middles = stored(sample.groupBy("lang").agg(middle), "lm-middle")
    overall = sample.agg(middle).first()[0]
    limits = sample.join(middles.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).drop("l").groupBy("lang", "middle").agg(high)
    overall_high = sample.withColumn("middle", F.lit(overall).cast("double")).agg(high).first()[0]
    limits = stored(limits, "lm-limits").withColumnRenamed("lang", "l")
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    out = out.withColumn("middle", F.coalesce("middle", F.lit(overall).cast("double"))).withColumn("threshold", F.coalesce("threshold", F.lit(overall_high).cast("double")))
    excess = F.when(F.col("n_bytes") > 0, (F.col("loss") - F.col("middle")) / unit)
    kept = F.coalesce(excess <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_bytes", F.exp("loss").alias("perplexity"), excess.alias("excess"), "threshold", kept.alias("kept"), *["digest"] * digests)


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, each by its own text and language."""
    # stored, as the filter and the exact join both read it
    rejected = score_quality(docs, labels, digests=True).filter(~F.col("kept"))
    doc, lang, digest = free_names(docs, "_bad", "_lang", "_digest")
    bad = stored(rejected.select(F.col("doc_id").alias(doc), F.col("lang").alias(lang), F.col("digest").alias(digest)).distinct(), "lm-rejected")
    return without(docs, bad, {doc: F.col("doc_id"), lang: F.col("lang").cast("string"), digest: text_key()})
