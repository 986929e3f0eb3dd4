"""Alignment of two tokenizers over the bytes of their tokens.

Tokenizer A encodes a space and the text, tokenizer B the text, to which it adds the space itself.  Their tokens cover the same
bytes; a text is aligned only if both give back exactly these.

1. *Incidence.*  The tokens of a batch of texts and the bytes that they cover make two sparse matrices (compressed rows, built by
   hand): a row per token, a column per run of bytes without an end of a token inside, its entries in A the run's length.
2. *Overlap links.*  The rows of ``A · Bᵀ`` are computed one after the other after Gustavson: a row of A selects rows of
   ``Bᵀ``, whose entries are added up by column.  An entry is a pair of tokens that overlap, its value the bytes that they share.
   Those whose byte ranges end together are the *links*; their ends cut the tokens into groups.
3. *Shared-group links.*  With a column per group instead of a run, the same product gives all pairs of tokens in one group.
4. *Counts.*  How many links of the corpus hold a pair of ids linked is summed over all documents.  The bytes of one token of a
   linked pair end those of the other, so there are at most as many pairs as the tokens of both vocabularies have bytes; with this
   bound (274,883 for the two given ones) the counts come to the driver and go out to all tasks.

Texts are encoded once, most of them from the ids that their pieces had before; the links of a document are kept as ids of pairs in the shared folder until the counts are known, of four
bytes each if the vocabularies allow: these are most of what the later passes move.

Defined results: null or empty texts, and those that a tokenizer does not give back, have no tokens: zeros, and the empty string
instead of a digest.  Rows come back as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Bytes of texts in one matrix, products computed at once.
BATCH_BYTES, AT_ONCE = 1 << 20, 1 << 20
#: Strings that a worker remembers the ids of, words that it encodes as one text.
MEMORY, RUN = 250_000, 64
#: Pieces of texts that a worker remembers the ids of, by both tokenizers, and those that it learns at once.
PIECES, LEARNED = 250_000, 4096
#: Fixed value: the splitting pattern of byte-level tokenizers.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


# --------------------------------------------------------------- matrices


@dataclass
class Csr:
    """A sparse matrix by rows: the entries of row ``i`` are at ``indptr[i]:indptr[i + 1]`` of ``indices`` and ``data``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return Csr(indptr, rows[order], self.data[order], len(self.indptr) - 1)


def incidence(runs: np.ndarray, data: np.ndarray) -> Csr:
    """Tokens that cover runs of bytes from the first on one after the other, each up to so many of ``runs``; ``data`` per run."""
    return Csr(np.concatenate([[0], runs]), np.arange(len(data)), data, len(data))


def membership(groups: np.ndarray, count: int) -> Csr:
    """Tokens by the one group that each is in."""
    return Csr(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), count)


def row_products(a: Csr, b: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``rows, columns, values`` of the entries of ``a · b`` in order, so many rows at once as make about ``AT_ONCE`` products."""
    reach = np.diff(b.indptr)[a.indices]
    work = np.concatenate([[0], np.cumsum(reach)])[a.indptr]
    row = 0
    while row < len(a.indptr) - 1:
        stop = max(row + 1, int(np.searchsorted(work, work[row] + AT_ONCE, side="right")) - 1)
        lo, hi = a.indptr[row], a.indptr[stop]
        n = reach[lo:hi]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(b.indptr[a.indices[lo:hi]], n) + inside
        rows = np.repeat(np.repeat(np.arange(row, stop), np.diff(a.indptr[row : stop + 1])), n)
        key, value = rows * b.columns + b.indices[at], np.repeat(a.data[lo:hi], n) * b.data[at]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        if len(key):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield key[first] // b.columns, key[first] % b.columns, np.add.reduceat(value, first)
        row = stop


# -------------------------------------------------------------- tokenizers


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library; it sees a space before the text.

    Its own splitting pattern cuts texts into strings that it encodes one by one; their ids are kept in a memory of about
    ``MEMORY`` strings.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.lossy: set[str] = set()  # strings that their ids do not give back
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if all(c in letters for c in entry):
                self.bytes[i] = bytes(letters[c] for c in entry)
        self.sizes = np.fromiter(map(len, self.bytes), np.int64)
        layout = json.loads(self.tokenizer.to_str())
        before = layout["pre_tokenizer"] or {}
        self.splits = layout["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)

    def arrays(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of the texts, and whether their bytes are those of space and text: surely, if those of all its strings are."""
        parts = [BYTE_LEVEL.findall(" " + t) if self.splits else [" " + t] for t in texts]
        strings = set(chain.from_iterable(parts))
        if len(self.known) > MEMORY:
            self.known, self.lossy = {}, set()
        new = list(strings - self.known.keys())
        words = [x for x in new if x[0] == " " and x[1:].isalpha()] if self.splits else []
        for i in range(0, len(words), 4096):
            self._learn_words(words[i : i + 4096])
        rest = [x for x in new if x not in self.known]
        for i in range(0, len(rest), 4096):
            for x, ids in zip(rest[i : i + 4096], self._ids(rest[i : i + 4096]), strict=True):
                self.known[x] = np.array(ids, np.int32).tobytes()
                if b"".join(map(self.bytes.__getitem__, ids)) != x.encode():
                    self.lossy.add(x)
        lossy = strings & self.lossy
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, p)), np.int32) for p in parts]
        surely = [sum(map(len, p)) == len(t) + 1 and (not lossy or lossy.isdisjoint(p)) for t, p in zip(texts, parts, strict=True)]
        return ids, [sure or self.gives_back(x, t) for sure, x, t in zip(surely, ids, texts, strict=True)]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        """Of letters after a space, which the pattern takes for a string of their own wherever they stand before another space:
        ``RUN`` of them are encoded as one text, and told apart by their bytes.  Without effect if their bytes do not come back."""
        runs = self._ids(["".join(words[i : i + RUN]) for i in range(0, len(words), RUN)])
        ids = np.fromiter(chain.from_iterable(runs), np.int32)
        coded = [x.encode() for x in words]
        if b"".join(map(self.bytes.__getitem__, ids.tolist())) != b"".join(coded):
            return
        ends, total = np.cumsum(np.fromiter(map(len, coded), np.int64)), np.cumsum(self.sizes[ids])
        cuts = np.searchsorted(total, ends)
        if (total[cuts] == ends).all():
            raw, at = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
            self.known.update((x, raw[a:b]) for x, (a, b) in zip(words, pairwise(at), strict=True))

    def gives_back(self, ids: np.ndarray, text: str) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())) == b" " + text.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.arrays(texts)[0]]


class Pieces:
    """A sentencepiece model that puts a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        ids = list(range(self.model.get_piece_size()))
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, self.model.id_to_piece(ids), strict=True)]
        self.sizes = np.fromiter(map(len, self.bytes), np.int64)
        # no piece goes on from another character to a space or a line feed
        self.splits = not any(regex.search(r"[^▁][▁ \n]", self.model.id_to_piece(i)) for i in ids)
        self.head = len(self.model.encode("a"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Of texts that begin with a space, which the model adds, or with a line feed."""
        ids = self.encode([x[1:] if x[0] == " " else "a" + x for x in texts])
        return [i if x[0] == " " else i[self.head :] for x, i in zip(texts, ids, strict=True)]

    def arrays(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """As of ``ByteLevel``: surely, if all texts together have the right bytes and each has the right number."""
        ids = [np.array(x, np.int32) for x in self.encode(texts)]
        want = [b" " + t.encode() for t in texts]
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        sizes = [int(self.sizes[x].sum()) for x in ids]
        if sizes == list(map(len, want)) and b"".join(map(self.bytes.__getitem__, flat.tolist())) == b"".join(want):
            return ids, [True] * len(texts)
        return ids, [b"".join(map(self.bytes.__getitem__, x.tolist())) == w for x, w in zip(ids, want, strict=True)]


def cut(text: str) -> list[str]:
    """Space and text, cut before every space and line feed."""
    return (" " + text).replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]


def closed(piece: str) -> bool:
    """Does it end with a visible character?"""
    return piece[-1].isalnum() or unicodedata.category(piece[-1])[0] not in "CZ"


class Together:
    """Ids of texts by both tokenizers, put together from the ids of their pieces.

    No token of either tokenizer goes on from a visible character to a space or a line feed, so a text cut there has the
    tokens of its pieces.  Texts with other white space before a cut, and those of which a tokenizer does not give back a piece, are
    encoded as they are.  A piece is a number in ``number``: of its ids in ``flat``, where they start and how many they are.
    """

    def __init__(self, one: ByteLevel | Pieces, two: ByteLevel | Pieces):
        self.sides = one, two
        self.splits = one.splits and two.splits
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32) for _ in self.sides]
        self.start = [np.zeros(0, np.int64) for _ in self.sides]
        self.count = [np.zeros(0, np.int64) for _ in self.sides]

    def _learn(self, pieces: list[str]) -> None:
        """``RUN`` pieces are encoded as one text and told apart by their bytes; those that do not come back are not learned."""
        coded = list(map(str.encode, pieces))
        ends, whole, got = np.cumsum(np.fromiter(map(len, coded), np.int64)), b"".join(coded), []
        for side in self.sides:
            runs = side._ids(["".join(pieces[i : i + RUN]) for i in range(0, len(pieces), RUN)])
            ids = np.fromiter(chain.from_iterable(runs), np.int32)
            total = np.cumsum(side.sizes[ids])
            cuts = np.searchsorted(total, ends)
            if b"".join(map(side.bytes.__getitem__, ids.tolist())) != whole or (total[cuts] != ends).any():
                step = len(pieces) // RUN or 1
                for i in range(0, len(pieces) if len(pieces) > 1 else 0, step):
                    self._learn(pieces[i : i + step])
                return
            got.append((ids, cuts + 1))
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces)), strict=True))
        for k, (ids, cuts) in enumerate(got):
            first = np.concatenate([[0], cuts[:-1]])
            self.start[k] = np.concatenate([self.start[k], first + len(self.flat[k])])
            self.count[k] = np.concatenate([self.count[k], cuts - first])
            self.flat[k] = np.concatenate([self.flat[k], ids])

    def arrays(self, texts: list[str]) -> list[tuple[list[np.ndarray], list[bool]]]:
        """Of each tokenizer, the ids of the texts, and whether their bytes are those of space and text."""
        parts = [cut(t) if self.splits and "\0" not in t else [] for t in texts]
        pieces = set(chain.from_iterable(parts))
        if len(self.number) > PIECES:
            self._forget()
        new = [x for x in pieces - self.number.keys() if closed(x)]
        for i in range(0, len(new), LEARNED):
            self._learn(new[i : i + LEARNED])
        odd = pieces - self.number.keys()
        apart = [i for i, p in enumerate(parts) if not p or odd and not odd.isdisjoint(p)]
        for i in apart:
            parts[i] = []
        sizes = list(map(len, parts))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes))
        out = []
        for side, flat, start, count in zip(self.sides, self.flat, self.start, self.count, strict=True):
            n = count[numbers]
            before = np.concatenate([[0], np.cumsum(n)])
            every = flat[np.repeat(start[numbers] - before[:-1], n) + np.arange(before[-1])]
            at = before[np.cumsum([0, *sizes])]
            ids, whole = [every[a:b] for a, b in pairwise(at.tolist())], [True] * len(texts)
            for i, x, sure in zip(apart, *side.arrays([texts[i] for i in apart]), strict=True):
                ids[i], whole[i] = x, sure
            out.append((ids, whole))
        return out


def _kept() -> dict:
    """What a worker that is used for many tasks keeps, in a module of its own, as functions come by value."""
    return sys.modules.setdefault("_lakeshift_aligners", types.ModuleType("_lakeshift_aligners")).__dict__


def tokenizer(path: str) -> ByteLevel | Pieces:
    """By the kind of file."""
    kept = _kept()
    if path not in kept:
        kept[path] = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return kept[path]


def together(path_a: str, path_b: str) -> Together:
    kept = _kept()
    if (path_a, path_b) not in kept:
        kept[path_a, path_b] = Together(tokenizer(path_a), tokenizer(path_b))
    return kept[path_a, path_b]


# --------------------------------------------------------------- alignment


@dataclass
class Alignment:
    """Aligned texts one after the other: token ids and ends of both sides, the texts' first tokens, links and groups."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    overlaps: tuple[np.ndarray, np.ndarray, np.ndarray]  # token of A, token of B, bytes shared
    links: tuple[np.ndarray, np.ndarray]
    ends: np.ndarray  # of the groups

    @cached_property
    def groups(self) -> list[np.ndarray]:
        """The group of each token of A, and of B."""
        return [np.searchsorted(self.ends, e) for e in (self.a_end, self.b_end)]

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        of_a, of_b = (membership(g, len(self.ends)) for g in self.groups)
        return row_products(of_a, of_b.transposed())


def align(ids_a: list[np.ndarray], ids_b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Alignment:
    """Align texts whose tokens cover the same bytes; with the numbers of bytes of both vocabularies."""
    sides = []
    for ids, table in ((ids_a, a_sizes), (ids_b, b_sizes)):
        flat = np.concatenate([np.zeros(0, np.int64), *ids])
        ends = np.cumsum(table[flat])
        sides.append((flat, ends, np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)))
    (a, a_end, a_cut), (b, b_end, b_cut) = sides
    cut = np.zeros((int(a_end[-1]) if len(a_end) else 0) + 1, bool)
    cut[a_end] = cut[b_end] = True
    cut[0] = False
    runs, size = np.cumsum(cut), np.diff(np.flatnonzero(cut), prepend=0)
    found = list(row_products(incidence(runs[a_end], size), incidence(runs[b_end], np.ones_like(size)).transposed()))
    i, j, shared = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    together = a_end[i] == b_end[j]
    return Alignment(a, b, a_end, b_end, a_cut, b_cut, (i, j, shared), (i[together], j[together]), a_end[i[together]])


def _aligned(path_a: str, path_b: str):
    """Batches of texts, each with which of its texts are aligned and their alignment."""

    def run(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, Alignment]]:
        both = together(path_a, path_b)
        raw = [t or "" for t in texts.to_pylist()]
        start = 0
        while start < len(raw):
            stop, size = start, 0
            while stop < len(raw) and (stop == start or size + len(raw[stop]) <= BATCH_BYTES):
                size, stop = size + len(raw[stop]), stop + 1
            part = raw[start:stop]
            (ids_a, whole_a), (ids_b, whole_b) = both.arrays(part)
            whole = [i for i, t in enumerate(part) if t and whole_a[i] and whole_b[i]]
            yield start, stop, np.array(whole, np.int64), align([ids_a[i] for i in whole], [ids_b[i] for i in whole], *[side.sizes for side in both.sides])
            start = stop

    return run


def _per_text(x: Alignment, tokens: np.ndarray) -> np.ndarray:
    """How many of the A tokens (with repeats) each text has."""
    return np.bincount(np.searchsorted(x.a_cut, tokens, side="right") - 1, minlength=len(x.a_cut) - 1)[: len(x.a_cut) - 1]


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The alignment itself, per document: ``doc_id, a_ids, b_ids``; ``a_groups, b_groups`` (tokens of each group); ``links``
    and ``overlaps`` as places of tokens (with the bytes shared)."""
    batches_of = _aligned(path_a, path_b)
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    over = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())])
    ints = pa.list_(pa.int32())
    kinds = {"a_ids": ints, "b_ids": ints, "a_groups": ints, "b_groups": ints, "links": pa.list_(pair), "overlaps": pa.list_(over)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, whole, x in batches_of(batch.column("text")):
                rows = [dict.fromkeys(kinds, []) for _ in range(start, stop)]
                for n, i in enumerate(whole.tolist()):
                    (a0, a1), (b0, b1) = x.a_cut[n : n + 2], x.b_cut[n : n + 2]
                    link = slice(*np.searchsorted(x.links[0], (a0, a1)))
                    over_ = slice(*np.searchsorted(x.overlaps[0], (a0, a1)))
                    la, lb = x.links[0][link] - a0, x.links[1][link] - b0
                    rows[i] = {
                        "a_ids": x.a[a0:a1].tolist(), "b_ids": x.b[b0:b1].tolist(),
                        "a_groups": np.diff(la, prepend=-1).tolist(), "b_groups": np.diff(lb, prepend=-1).tolist(),
                        "links": [{"a": p, "b": q} for p, q in zip(la.tolist(), lb.tolist(), strict=True)],
                        "overlaps": [{"a": p, "b": q, "bytes": m} for p, q, m in zip((x.overlaps[0][over_] - a0).tolist(), (x.overlaps[1][over_] - b0).tolist(), x.overlaps[2][over_].tolist(), strict=True)],
                    }
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), *[pa.array([r[c] for r in rows], t) for c, t in kinds.items()]], ["doc_id", *kinds])

    schema = "doc_id long, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>, links array<struct<a:int,b:int>>, overlaps array<struct<a:int,b:int,bytes:int>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def groups_texts(x: Alignment, width: int) -> Iterator[str]:
    """Per text ``a1,a2|b1;a3|b2,b3``; ``width`` is the number of B ids."""
    of = x.groups
    part = np.concatenate([2 * of[0], 2 * of[1] + 1])  # the two sides of a group, in order
    order = np.argsort(part, kind="stable")
    part, ids = part[order], np.concatenate([x.a + width, x.b])[order]
    goes_on = np.concatenate([part[1:] == part[:-1], [False]])
    after = np.where(goes_on, 0, 1 + (part & 1))
    names = _kept().setdefault(("names", width), [])
    for i in range(len(names) // 3, int(ids.max(initial=0)) + 1):  # every id with each mark that may follow it
        name = str(i - width if i >= width else i)
        names += [name + ",", name + "|", name + ";"]
    marks = list(map(names.__getitem__, (3 * ids + after).tolist()))
    for lo, hi in pairwise((x.a_cut + x.b_cut).tolist()):
        yield "".join(marks[lo:hi])[:-1]


def pair_kind(count: int) -> str:
    """What the ids of ``count`` pairs are kept as."""
    return "<u4" if count <= 1 << 32 else "<i8"


def _digest(path_a: str, path_b: str, width: int, kind: str = "<i8"):
    batches_of = _aligned(path_a, path_b)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, whole, x in batches_of(batch.column("text")):
                counts = np.zeros((len(names), stop - start), np.int64)
                sha, pairs = [""] * (stop - start), [b""] * (stop - start)
                links = _per_text(x, x.links[0])
                shared = np.zeros(len(whole), np.int64)
                for rows, _, _ in x.shared_groups():
                    shared += _per_text(x, rows)
                groups = np.diff(np.searchsorted(x.ends, np.concatenate([[0], x.a_end])[x.a_cut], side="right"))
                counts[:, whole] = [np.diff(x.a_cut), np.diff(x.b_cut), groups, links, _per_text(x, x.overlaps[0]), shared]
                key = (x.a[x.links[0]].astype(np.int64) * width + x.b[x.links[1]]).astype(kind)
                at = np.concatenate([[0], np.cumsum(links)])
                for n, (i, text) in enumerate(zip(whole.tolist(), groups_texts(x, width), strict=True)):
                    sha[i], pairs[i] = hashlib.sha256(text.encode()).hexdigest(), key[at[n] : at[n + 1]].tobytes()
                columns = [batch.column("doc_id").slice(start, stop - start), *map(pa.array, counts), pa.array(sha, pa.string()), pa.array(pairs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "groups_sha256", "pairs"])

    return run


def _keys(batch: pa.RecordBatch, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("pairs").to_pylist()), kind)


def _sizes(batch: pa.RecordBatch, kind: str) -> np.ndarray:
    return pa.compute.binary_length(batch.column("pairs")).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize


def _slices(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``AT_ONCE`` links."""
    for batch in batches:
        total = np.concatenate([[0], np.cumsum(_sizes(batch, kind))])
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(total, total[row] + AT_ONCE, side="right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(0, kind), np.zeros(0, np.int64)
        for batch in _slices(batches, kind):
            more, m = np.unique(_keys(batch, kind), return_counts=True)
            seen, place = np.unique(np.concatenate([seen, more]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, m]), minlength=len(seen)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(n, pa.int64())], ["pair", "n"])

    return run


def _weigh(counts, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = counts.value
        for batch in _slices(batches, kind):
            sizes = _sizes(batch, kind)
            at = np.searchsorted(pairs, _keys(batch, kind))
            ends = np.cumsum(sizes)
            sums = [np.concatenate([[0], np.cumsum(v[at])]) for v in (best.astype(np.int64), n)]
            rest = [c for c in batch.schema.names if c != "pairs"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *[pa.array(s[ends] - s[ends - sizes]) for s in sums]], [*rest, "n_best", "count_sum"])

    return run


def pair_counts(linked: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pairs that any link holds, in order, and how many do; bounded by the bytes of both vocabularies."""
    rows = linked.select("pairs").mapInArrow(_count(kind), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas().sort_values("pair")
    return rows.pair.to_numpy(np.int64), rows.n.to_numpy(np.int64)


def alignment_digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_shared, groups_sha256, n_best, count_sum`` per row of ``docs``.

    ``n_best`` counts the links whose pair is the most counted of its B id, ``count_sum`` adds the counts of all links' pairs.
    """
    spark = docs.sparkSession
    width = len(tokenizer(path_b).bytes)
    kind = pair_kind(len(tokenizer(path_a).bytes) * width)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_shared long, groups_sha256 string, pairs binary"
    linked = stored(docs.select("doc_id", text_of().alias("text")).mapInArrow(_digest(path_a, path_b, width, kind), schema), "alignment")
    pairs, n = pair_counts(linked, kind)
    most = np.zeros(width, np.int64)
    np.maximum.at(most, pairs % width, n)
    counts = spark.sparkContext.broadcast((pairs.astype(kind), n, n == most[pairs % width]))
    return linked.mapInArrow(_weigh(counts, kind), schema.replace("pairs binary", "n_best long, count_sum long"))
