"""Spelling variants of a vocabulary by an index of variable-length grams.

Words are the distinct results, of ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences or more, of counting the maximal
runs of letters of all texts (A-Z lower-cased), where a share of the runs loses a letter by rule.  Two words are near
if exactly one inserted, deleted or replaced code point makes one of the other.

1. *Vocabulary.*  Tasks count the runs of their documents and send partial counts.
2. *Gram dictionary.*  A word stands between two marks.  A gram of two code points or more is *frequent* if more words than the
   pruning limit hold it (counted by place).  At each place of a word the gram grows from two code points for as long as what it has is frequent, up to
   the longest length: rare beginnings stay short, frequent ones are told apart by longer grams.  The limit follows the
   size of the vocabulary such that at most ``MOST_FREQUENT`` grams a length can be frequent, which bounds the broadcast.
3. *Decomposition.*  The grams of a word, without those that lie inside an earlier one; a gram's repeats are numbered.
4. *Bounds.*  An edit at a place changes the grams that cover it, and may hide grams after it that a gram grown across the edit
   covers: those that end within the longest length.  Their greatest number over all edits is the word's bound ``NAG``.  Near words
   share all but ``NAG`` grams of either, so with grams in one order, rarest first, they share one of the first ``NAG + 1`` of both: only
   these lists of each word are merged.  At least one gram is always left: marked words are at least twice as long as the longest gram
   of their scheme.  Words of up to ``SCHEMES[0]`` code points use grams up to 3, longer ones up to 5, those
   of the length in between both, so any two near words have a scheme in common.
5. *Verify.*  Near words agree in the half of the word before or after the edit, so the words of a list meet where they also agree in
   a half, and their code points are compared.  Lists of more than ``LONG_LIST`` words are dealt by the halves, so no task holds a long list.

Defined results: null texts have no runs; a null id counts as an empty string in the rule; an empty table gives no rows; rows
that repeat count as often as they come; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored
from .hashing import mix

LEAST_LENGTH, LEAST_COUNT, LOSES = 5, 3, 97
#: Frequent grams of a length, at most; a gram that so many words hold or fewer is never frequent.
MOST_FREQUENT, LEAST_FREQUENT = 100_000, 32
#: Longest word of the first scheme and shortest of the second; longest gram of each.
BETWEEN, LONGEST_GRAM = 8, (3, 5)
#: Words of a list that one task takes whole; pairs that it compares at once; words that a counting task holds.
LONG_LIST, AT_ONCE, HELD = 20_000, 1 << 20, 400_000
#: Code points of a word that is compared in a table; longer ones are compared one by one.
WIDEST = 64
#: Marks of a word's beginning and end.
BEGIN, END = "\x02", "\x03"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_FOLD = {c: c + 32 for c in range(65, 91)}
_U, _ALL = np.uint64, 2**64 - 1
#: Powers of an odd number and of its inverse, modulo 2**64.
_UP, _DOWN = (np.array([pow(base, i, 2**64) for i in range(WIDEST + 2)], np.uint64) for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)))


# ------------------------------------------------------------- vocabulary


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
            before = zlib.crc32(f"{doc}:".encode())
            for run, n in Counter(RUN.findall((text.as_py() or "").translate(_FOLD))).items():
                h = zlib.crc32(run.encode(), before)
                if h % LOSES == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                total[run] += n
            if len(total) > HELD:
                yield flush()
    yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the words and their occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text").mapInArrow(_count_runs, "word string, n long")
    words = runs.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))
    return words.filter(F.col("n") >= LEAST_COUNT)


# ------------------------------------------------------------------ grams


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            w = BEGIN + word + END
            for q in range(2, LONGEST_GRAM[1] + 1):
                total.update(w[i : i + q] for i in range(len(w) - q + 1))
        if len(total) > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["gram", "n"])
            total.clear()
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["gram", "n"])


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """The frequent grams with their counts: at most ``MOST_FREQUENT`` of each length."""
    places = words.agg(F.coalesce(F.sum(F.char_length("word") + 1), F.lit(0))).first()[0]
    limit = max(LEAST_FREQUENT, places // MOST_FREQUENT)
    grams = words.select("word").mapInArrow(_count_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in grams.filter(F.col("n") > limit).collect()}


def decompose(w: str, frequent: dict[str, int], longest: int) -> list[tuple[int, int]]:
    """The grams of a marked word, as ``(first place, place after the last)``."""
    out, reach = [], 0
    for p in range(len(w) - 1):
        e = p + 2
        while e < len(w) and e - p < longest and w[p:e] in frequent:
            e += 1
        if e > reach:
            out.append((p, e))
            reach = e
    return out


def most_affected(grams: list[tuple[int, int]], longest: int) -> int:
    """The greatest number of grams of a marked word that one edit can change or hide.

    Replacing or deleting place ``i`` changes the grams that cover it and hides later ones that end by ``i + longest``: those that end
    after ``i`` and by ``i + longest``.  Inserting before ``i`` reaches no further.  Both marks stay, so ``i`` is 1 or more.
    """
    ends = [e for _, e in grams]
    first = most = 0
    for last, e in enumerate(ends):
        while ends[first] <= max(1, e - longest):
            first += 1
        most = max(most, last - first + 1)
    return most


def schemes(length: int) -> list[int]:
    """The longest grams of the schemes that a word of ``length`` code points takes part in."""
    return [LONGEST_GRAM[0]] * (length <= BETWEEN) + [LONGEST_GRAM[1]] * (length >= BETWEEN)


def lists_of(word: str, frequent: dict[str, int], longest: int) -> list[str]:
    """The lists that the word stands in: its ``NAG + 1`` rarest grams, each with its scheme and number of repeat."""
    w = BEGIN + word + END
    grams = decompose(w, frequent, longest)
    seen: Counter = Counter()
    keys = []
    for p, e in grams:
        seen[w[p:e]] += 1
        keys.append((frequent.get(w[p:e], 0), f"{longest}{seen[w[p:e]]}:{w[p:e]}"))
    return [key for _, key in sorted(keys)[: most_affected(grams, longest) + 1]]


def _index(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                own = [k for longest in schemes(len(word)) for k in lists_of(word, frequent.value, longest)]
                keys += own
                at += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("word").take(at), batch.column("n").take(at)], ["list", "word", "n"])

    return run


# ----------------------------------------------------------------- verify


def _half_keys(code: np.ndarray, size: np.ndarray, words: list[str]) -> np.ndarray:
    """Per word four numbers: its first and second half as the shorter (or equal) and as the longer word of a pair, each with the
    length of the shorter one.  Equal halves have equal numbers; others only by chance, which costs a comparison."""
    n, width = code.shape
    hash_of = np.zeros((n, width + 1), np.uint64)
    np.cumsum((code.astype(np.uint64) + _U(1)) * _UP[:width], axis=1, out=hash_of[:, 1:])
    rows = np.arange(n)
    out = np.empty((n, 4), np.uint64)
    for k, shorter in ((0, size), (2, size - 1)):
        h = shorter // 2
        begin, stop = size - (shorter - h), np.minimum(size, width)
        begin = np.minimum(begin, stop)
        out[:, k] = hash_of[rows, np.minimum(h, width)] * _U(2)
        out[:, k + 1] = (hash_of[rows, stop] - hash_of[rows, begin]) * _DOWN[begin] * _U(2) + _U(1)
        for i in np.flatnonzero(shorter > WIDEST):
            w, m = words[i], int(h[i])
            out[i, k], out[i, k + 1] = hash(w[:m]) & _ALL, hash((w[len(w) - (int(shorter[i]) - m) :], 1)) & _ALL
        out[:, k : k + 2] = mix(out[:, k : k + 2] + shorter.astype(np.uint64)[:, None] * _U(0xD1342543DE82EF95))
    return out


def _pairs_in_runs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of every run, the run's first place first, about ``AT_ONCE`` at a time."""
    place = np.repeat(starts, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    after = np.repeat(starts + sizes, sizes) - place - 1
    cuts = np.searchsorted(np.cumsum(after), np.arange(0, after.sum() + AT_ONCE, AT_ONCE), side="right")
    for a, b in zip(cuts, [*cuts[1:], len(place)], strict=True):
        if a < b:
            one = np.repeat(place[a:b], after[a:b])
            yield one, one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(after[a:b]) - after[a:b], after[a:b])


def is_near(a: str, b: str) -> bool:
    """Does exactly one inserted, deleted or replaced code point make ``b`` of ``a``, which is not longer?"""
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def near_pairs(lists: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of words of one list that are near; ``lists`` numbers the list of each word."""
    n = len(words)
    size = np.array([len(w) for w in words], np.int64)
    code = np.zeros((n, min(int(size.max(initial=0)), WIDEST) + 1), np.uint32)
    for i, w in enumerate(words):
        if len(w) <= WIDEST + 1:  # one more: as the longer of a pair it meets words of WIDEST
            code[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
    # four rows per word: as the shorter and the longer of a pair, by its first and its second half
    at = np.tile(np.arange(n), 4)
    longer = np.repeat([0, 0, 1, 1], n)
    key = mix(_half_keys(code, size, words).T.reshape(-1) ^ mix(np.tile(lists, 4).astype(np.uint64)))
    order = np.lexsort((longer, key))
    at, longer, key = at[order], longer[order], key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff([*starts, len(key)])
    found = []
    for one, two in _pairs_in_runs(starts, sizes):
        take = longer[one] == 0  # the shorter word first; two longer ones meet elsewhere
        a, b, gap = at[one[take]], at[two[take]], longer[two[take]]
        take = (size[b] - size[a] == gap) & (a != b)
        a, b, gap = a[take], b[take], gap[take]
        for i in np.flatnonzero(size[b] > WIDEST):
            if is_near(words[a[i]], words[b[i]]):
                found.append(np.array([[a[i]], [b[i]]]))
        take = size[b] <= WIDEST
        a, b, gap = a[take], b[take], gap[take]
        # code points that agree from the front, and from the back behind the edit
        front = np.argmin(np.concatenate([code[a] == code[b], np.zeros((len(a), 1), bool)], axis=1), axis=1)
        front = np.minimum(front, size[a])
        rest = size[a] - front - (gap == 0)
        same = np.ones(len(a), bool)
        for j in range(int(rest.max(initial=0))):
            live = j < rest
            same[live] &= code[a[live], size[a[live]] - 1 - j] == code[b[live], size[b[live]] - 1 - j]
        same &= (gap == 1) | (front < size[a])
        found.append(np.stack([a[same], b[same]]))
    both = np.unique(np.concatenate([np.sort(f, axis=0) for f in found], axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows sorted by list, the smaller word first; each list is taken whole, many at once."""

    def near(table: pa.Table) -> pa.RecordBatch:
        words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        a, b = near_pairs(pd.factorize(table.column("list").to_pandas())[0], words)
        turn = np.fromiter((words[i] > words[j] for i, j in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        column = pa.array(words, pa.string())
        return pa.RecordBatch.from_arrays([column.take(pa.array(a)), pa.array(n[a], pa.int64()), column.take(pa.array(b)), pa.array(n[b], pa.int64())], ["word", "n", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) >= LONG_LIST:
            table = pa.Table.from_batches(held)
            names = table.column("list").combine_chunks()
            last = int(np.searchsorted(np.array(pa.compute.equal(names, names[-1])), True)) if names[0] != names[-1] else 0
            if last:  # the last list may go on
                yield near(table.slice(0, last))
                held = table.slice(last).to_batches()
    if held:
        yield near(pa.Table.from_batches(held))


def _dealt(index: DataFrame) -> DataFrame:
    """``list, word, n`` of lists with two words or more; long lists as one list per half."""
    sizes = index.groupBy("list").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = index.join(sizes, "list")
    length = F.char_length("word")
    half = []
    for shorter in (length, length - 1):
        h = F.floor(shorter / 2).cast("int")
        half += [F.concat_ws(":", "list", shorter, F.lit("0"), F.substring("word", F.lit(1), h)), F.concat_ws(":", "list", shorter, F.lit("1"), F.substring("word", length - shorter + h + 1, shorter - h))]
    short = rows.filter(F.col("size") <= LONG_LIST).select("list", "word", "n")
    return short.unionByName(rows.filter(F.col("size") > LONG_LIST).select(F.explode(F.array(*half)).alias("list"), "word", "n"))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every pair of near words, in both directions."""
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words))
    index = words.mapInArrow(_index(frequent), "list string, word string, n long")
    dealt = _dealt(stored(index, "gram-index")).repartition(shuffle_partitions(words.sparkSession), "list").sortWithinPartitions("list")
    pairs = dealt.mapInArrow(_verify, "word string, n long, near string, near_n long").distinct()
    turned = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.inline(F.array(F.struct("word", "n", "near", "near_n"), turned)))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: forms followed to the last, by doubling the step; counts grow along a chain, so it ends.

    Every word stays in the table to the end: a root that it does not hold has no form, so it is the last.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-step")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        on = stored(now.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-step")
        now = on.select("word", "root")
        if on.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word of ``docs`` (``doc_id, text``).

    ``form`` is the near word of largest ``n`` (ties: smallest), if that is at least twice the word's; ``root`` the last of the
    forms of forms, the word itself without any.
    """
    words = stored(vocabulary(docs), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    of = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    found = F.col("form_n") >= 2 * F.col("n")
    of = stored(of.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(found, F.col("best.form")).alias("form"), F.when(found, F.col("form_n")).alias("form_n")), "spelling-forms")
    roots = _roots(of.filter("form is not null").select("word", "form"))
    return of.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
