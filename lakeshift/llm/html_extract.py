"""Main text of web pages: structure first, then a suffix array per host.

A page's markup gives its blocks of text, each in one of three zones: *article* (inside an ``article``, on
pages without one inside ``main``), *furniture* (menus, headers, footers, sidebars, notices, adverts, forms, reader comments, by element or by
class, id and role), and *open* (neither).  Scripts, styles and the head have no text.

* On a page with article blocks these are the candidates, and markup speaks for them.  An article may share passages with others (licence
  lines, quotations, copies of the page), so the host must contradict it: a block of
  ``min_tokens`` or more goes, whole, if every token of it is covered by windows that
  article blocks of ``most_pages`` distinct contents or more hold, and of ``MOST`` of all contents of the host that have an article.  A page that would
  lose half of its tokens so is a near copy of others, and stays whole.  Where a window begins a block is where it is looked for first: a block
  whose first window is not so common has a first token that nothing covers, so only the other blocks' further suffixes are sorted.
* On other pages, the open blocks are the candidates, and the host decides.  The token streams of all open and
  furniture blocks of a host's pages are one long text; its suffixes are sorted by their first ``min_tokens``
  tokens, and where neighbours in that order agree on them and come from ``min_pages`` distinct page contents or more, these
  tokens are boilerplate.  (A content is a page's article or open blocks, so copies of a page under many ids count once.)  Longer repeats are overlapping runs of such windows, so all repeats of ``min_tokens`` or more
  are covered.  (A block with fewer tokens repeats as a whole.)  Covered tokens go, unique runs stay.

The suffix array is a relation ``(host, window, page, block, position)`` grouped by ``(host, window)``; no task holds a host, and
windows are first made distinct per content and counted on the map side, so a host or a menu line with a
third of all pages is one row per content and partition.  Windows that most contents of a host hold are about as many as one page's.  Pages are parsed once; the parsed blocks are stored.

Text: character references decoded, white space inside a block is one space, trimmed, blocks in page order
joined by one newline.  Defined results: null or empty html gives an empty text; markup that never closes ends with
its page; null urls share one nameless host; repeated rows are extracted as rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import stored
from .html_blocks import blocks
from .url_filter import url_parts

MIN_TOKENS = 8
MIN_PAGES = 3
#: Contents that hold a boilerplate window in their article, at least; and their share, in per cent, of the host's contents with an article.
MOST_PAGES, MOST = 10, 80
PARSED = "page_id long, url string, host string, content binary, article array<string>, open array<string>, furniture array<string>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content, main, free, rest = [], [], [], []
        for html in batch.column("html").to_pylist():
            found = blocks(html)
            article = [t for zone, t in found if zone == "article"] or [t for zone, t in found if zone == "main"]
            main.append(article)
            free.append([] if article else [t for zone, t in found if zone == "open"])
            rest.append([t for zone, t in found if zone == "furniture" or article and zone != "article"])
            content.append(hashlib.blake2b("\n".join(article or free[-1] or rest[-1]).encode(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).cast(t) for c, t in (("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()))] + [pa.array(content, pa.binary()), *[pa.array(x, pa.list_(pa.string())) for x in (main, free, rest)]],
            ["page_id", "url", "host", "content", "article", "open", "furniture"],
        )


def _windows(texts: list[str], min_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(block, first token, hash of the window)``; of a block with fewer tokens, all of it."""
    of, first, hashes = [], [], []
    for start, data, a, b in hashing.batches(pa.array(texts, pa.large_string())):
        words, lo, hi = hashing.words(data, a, b)
        block, h = hashing.shingles(words, lo, hi, min_tokens)
        of.append(block + start)
        hashes.append(h)
        first.append(np.arange(len(block)) - np.searchsorted(block, block))
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return cat(of, np.int64), cat(first, np.int64), cat(hashes, np.uint64)


def _suffixes(min_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, hosts, out = batch.column("content").to_pylist(), batch.column("host").to_pylist(), ([], [], [])
            for content, host, free, rest in zip(contents, hosts, batch.column("open").to_pylist(), batch.column("furniture").to_pylist(), strict=True):
                windows = np.unique(_windows([*free, *rest], min_tokens)[2]).astype(np.int64).tolist()
                out[0].extend([host] * len(windows))
                out[1].extend(windows)
                out[2].extend([content] * len(windows))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["host", "window", "content"])

    return run


def _open_windows(min_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = ([], [])
            for key, host, free in zip(batch.column("row").to_pylist(), batch.column("host").to_pylist(), batch.column("open").to_pylist(), strict=True):
                windows = np.unique(_windows(free, min_tokens)[2]).astype(np.int64).tolist()
                cols[0].extend([(key, host)] * len(windows))
                cols[1].extend(windows)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cols[0]], pa.string()), pa.array([h for _, h in cols[0]], pa.string()), pa.array(cols[1], pa.int64())], ["row", "host", "window"])

    return run


def unique_runs(texts: list[str], repeated: set[int], min_tokens: int) -> str:
    """The blocks without the tokens that a repeated window covers."""
    tokens = [t.split(" ") for t in texts]
    covered = [np.zeros(len(t), bool) for t in tokens]
    for block, first, window in zip(*_windows(texts, min_tokens), strict=True):
        if int(window.astype(np.int64)) in repeated:
            covered[block][first : first + min_tokens] = True
    left = [" ".join(w for w, gone in zip(t, c, strict=True) if not gone) for t, c in zip(tokens, covered, strict=True)]
    return "\n".join(t for t in left if t)


def _finish(min_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [unique_runs(free, set(gone or ()), min_tokens) for free, gone in zip(batch.column("open").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def _article_windows(min_tokens: int, first_only: bool):
    """``host, window, content`` of article blocks: their first windows, or all windows of the blocks whose first is in ``common``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of, known = [], [], []
            common = None if first_only else batch.column("common").to_pylist()
            for i, blocks_of in enumerate(batch.column("article").to_pylist()):
                blocks_of = [t for t in blocks_of if t.count(" ") + 1 >= min_tokens]
                texts += [" ".join(t.split(" ", min_tokens)[:min_tokens]) for t in blocks_of] if first_only else blocks_of
                of += [i] * len(blocks_of)
            block, first, window = _windows(texts, min_tokens)
            window, page = window.astype(np.int64), np.array(of, np.int64)[block]
            if not first_only:
                known = [set(c) for c in common]
                begins = np.zeros(len(texts), bool)
                starts = np.flatnonzero(first == 0)
                begins[block[starts]] = [w in known[p] for w, p in zip(window[starts].tolist(), page[starts].tolist(), strict=True)]
                window, page = window[begins[block]], page[begins[block]]
            rows = pd.DataFrame({"page": page, "window": window}).drop_duplicates()
            at = pa.array(rows.page.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("host").take(at), pa.array(rows.window.to_numpy(), pa.int64()), batch.column("content").take(at)], ["host", "window", "content"])

    return run


def kept_blocks(article: list[str], common: set[int], min_tokens: int) -> list[str]:
    """The blocks that ``common`` windows do not cover; all of them where the covered ones hold half of the tokens or more."""
    block, _, window = _windows(article, min_tokens)
    size = np.array([t.count(" ") + 1 for t in article])
    covered = size >= min_tokens
    covered[block[[w not in common for w in window.astype(np.int64).tolist()]]] = False
    return article if 2 * size[covered].sum() >= size.sum() else [t for t, gone in zip(article, covered.tolist(), strict=True) if not gone]


def _without_common(min_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(kept_blocks(article, set(common), min_tokens)) for article, common in zip(batch.column("article").to_pylist(), batch.column("common").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def _articles(pages: DataFrame, min_tokens: int, most_pages: int) -> DataFrame:
    """``page_id, url, text`` of parsed pages with article blocks."""
    contents = pages.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("contents")).filter(F.col("contents") >= most_pages)
    columns = "host string, window long, content binary"

    def common(windows: DataFrame) -> DataFrame:
        """``host, common``: the windows that most contents of the host hold."""
        held = windows.distinct().groupBy("host", "window").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= most_pages)
        held = held.join(contents, "host").filter(F.col("pages") * 100 >= F.col("contents") * MOST)
        return stored(held.groupBy("host").agg(F.collect_list("window").alias("common")), "html-common")

    whole = pages.select("page_id", "url", F.array_join("article", "\n").alias("text"))
    begin = common(pages.select("host", "content", "article").mapInArrow(_article_windows(min_tokens, True), columns))
    if begin.isEmpty():
        return whole
    every = common(pages.join(begin, "host").select("host", "content", "article", "common").mapInArrow(_article_windows(min_tokens, False), columns))
    doubted = pages.join(every, "host").select("page_id", "url", "article", "common").mapInArrow(_without_common(min_tokens), "page_id long, url string, text string")
    return pages.join(every, "host", "left_anti").select(*whole.columns[:2], F.array_join("article", "\n").alias("text")).unionByName(doubted)


def extract_text(pages: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, most_pages: int = MOST_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``."""
    host = F.coalesce(url_parts(F.col("url"))[0], F.lit(""))
    parsed = stored(pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), "html").mapInArrow(_parse, PARSED), "html-parsed")
    undecided = parsed.filter(F.size("open") > 0)
    # only hosts with an open page need their furniture
    suffixes = parsed.join(undecided.select("host").distinct(), "host", "left_semi").select("content", "host", "open", "furniture").mapInArrow(_suffixes(min_tokens), "host string, window long, content binary")
    repeated = suffixes.distinct().groupBy("host", "window").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages).select("host", "window")

    undecided = undecided.withColumn("row", F.sha2(F.concat_ws("\x01", F.col("page_id"), F.col("url"), F.array_join("open", "\n")), 256))
    gone = undecided.select("row", "host", "open").distinct().mapInArrow(_open_windows(min_tokens), "row string, host string, window long").join(repeated, ["host", "window"])
    gone = gone.groupBy("row").agg(F.collect_set("window").alias("gone"))
    decided = undecided.join(gone, "row", "left").select("page_id", "url", "open", "gone").mapInArrow(_finish(min_tokens), "page_id long, url string, text string")
    empty = parsed.filter((F.size("open") == 0) & (F.size("article") == 0)).select("page_id", "url", F.lit("").alias("text"))
    articles = _articles(parsed.filter(F.size("article") > 0), min_tokens, most_pages)
    return articles.unionByName(decided).unionByName(empty).withColumn("n_chars", F.char_length("text").cast("long"))
