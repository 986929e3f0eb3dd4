"""Tensored MinHash, cross-tokenizer alignment and spelling variants against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_text import docs, join_brute, near_copies

from lakeshift.llm import hashing, linking, ngram_join, spelling, tensor_minhash, token_align


def edited(seed, groups):
    """Copies of texts with few, many and very many words replaced, so that similarities lie on both sides of the threshold."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyz") + str(rnd.randint(0, 400))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rnd.randint(6, 220))]
        for c in range(rnd.choice([1, 2, 9])):
            copy = [word() if rnd.random() < 0.012 * c else w for w in base]
            rows.append((1000 * g + c + 1, " ".join(copy)))
    return rows


@pytest.mark.parametrize(("k", "threshold", "block"), [(4, 80, 256), (4, 80, 3), (5, 90, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, k, threshold, block):
    monkeypatch.setattr(linking, "BLOCK", block)
    monkeypatch.setattr(linking, "WIDE", 2 * block)
    rows = near_copies(k + block, 12, 150) + edited(block, 16)
    rows += [(90000, None), (90001, ""), (90002, " \n"), (90003, "a b"), (90004, "A  b"), (90005, "a"), (90006, "a b c d e f g h i j"), (90006, "q r s t u v"), (None, "lone words here and there"), (None, "lone Words here and there")]
    got = tensor_minhash.near_duplicates(docs(spark, rows), k, threshold).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == join_brute(rows, k, threshold)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert tensor_minhash.near_duplicates(docs(spark, [])).count() == 0
    assert [tuple(r) for r in tensor_minhash.near_duplicates(docs(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
    with pytest.raises(ValueError):
        tensor_minhash.near_duplicates(docs(spark, []), 5, 60)


def test_copies_with_changes_of_their_own_meet_no_group(spark, monkeypatch):
    """Each was compared with all of its group, though most of its shingles are in no other text."""
    monkeypatch.setattr(ngram_join, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(ngram_join, "SHARD_TOKENS", 500)
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["end"]))]
    rows += [(10 + c, " ".join(f"own{c}x{i}" if i % 9 == 0 else w for i, w in enumerate(base))) for c in range(30)]
    compared, link_nodes = [], tensor_minhash.link_nodes
    monkeypatch.setattr(tensor_minhash, "link_nodes", lambda index, threshold: compared.extend(index.collect()) or link_nodes(index, threshold))
    got = tensor_minhash.near_duplicates(docs(spark, rows), 4, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == join_brute(rows, 4, 80)
    assert len(compared) == 2
    # the shingles that no other text has are left out, but count
    assert sorted((r.n, len(r.tokens) // 8, sum(np.frombuffer(r.sketch, "<u4"))) for r in compared) == [(57, 56, 56), (57, 57, 57)]


def test_bands_estimate_similarity():
    """A band of ``r`` minhashes is shared with probability ``s**r``; the two collections are independent of each other."""
    rnd = np.random.default_rng(4)
    shared, s = np.zeros(2), 0.6
    for _ in range(400):
        x = hashing.mix(rnd.integers(1, 2**62, 160, dtype=np.uint64))
        b = tensor_minhash.bands_of(np.concatenate([x[:128], x[32:]]), np.array([0, 128]))  # 96 of 160 in common
        hit = b[0] == b[1]
        shared += hit[: tensor_minhash.BANDS].mean(), hit[tensor_minhash.BANDS :].mean()
    assert np.allclose(shared / 400, s**tensor_minhash.ROWS, atol=0.03)


# -------------------------------------------------------------- alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align_brute(rows):
    """The contract of the query, token by token."""
    one, two = token_align.tokenizer(A), token_align.tokenizer(B)
    out = []
    for i, text in rows:
        a, b = one.tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids, two.model.encode(text or "")
        want = b" " + (text or "").encode()
        if not text or b"".join(one.bytes[x] for x in a) != want or b"".join(two.bytes[x] for x in b) != want:
            out.append((i, [], [], [], []))
            continue
        ends = lambda ids, table: np.cumsum([len(table[x]) for x in ids]).tolist()
        ea, eb = ends(a, one.bytes), ends(b, two.bytes)
        links = [(x, y) for x, e in zip(a, ea, strict=True) for y, f in zip(b, eb, strict=True) if e == f]
        groups, la, lb = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            groups.append(([x for x, e in zip(a, ea, strict=True) if la < e <= cut], [y for y, f in zip(b, eb, strict=True) if lb < f <= cut]))
            la = lb = cut
        out.append((i, a, b, links, groups))
    n = Counter(p for _, _, _, links, _ in out for p in links)
    top = {}
    for (_, y), m in n.items():
        top[y] = max(m, top.get(y, 0))
    rows = []
    for i, a, b, links, groups in out:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n[p] == top[p[1]] for p in links)
        rows.append((i, len(a), len(b), len(groups), len(links), best, sum(n[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(rows, key=str)


TEXTS = ["plain words, and more words", "", None, "<s> a </s> ▁ x", "▁", "a  b\t\n c  ", "été ﬁ ½ 日本語 😀", "<|endoftext|> <0x41>", "\x00\x01", "supercalifragilistic " * 40, " lead", "x" * 3000, "plain words, and more words", "1234567890" * 9]


def test_alignment_equals_brute_force(spark, monkeypatch):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)] + [(1, "plain words")]
    want = align_brute(rows)
    got = token_align.alignment_digests(docs(spark, rows).repartition(3), A, B).collect()
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got), key=str) == want
    assert token_align.alignment_digests(docs(spark, []), A, B).count() == 0


def test_texts_in_strings_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(token_align, "MEMORY", 5000)
    rnd = random.Random(5)
    alphabet = [*"abcdefgXYZ019.,'-|<>/é ß日😀\u2028\u00a0\u0301\x00▁", " ", " ", "  ", "\n", "\t", "\r\n", "the ", " ing", "<s>", "<0x0A>", "<|endoftext|>", "'re", "\u3000"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(6000)]
    one = token_align.tokenizer(A)
    assert one.splits
    for part in (texts[:3000], texts[3000:]):
        assert one.encode(part) == [e.ids for e in one.tokenizer.encode_batch([" " + t for t in part], add_special_tokens=False)]


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 21), (10, 7)])
def test_links_of_the_products(monkeypatch, limits):
    monkeypatch.setattr(token_align, "BATCH_BYTES", limits[0])
    monkeypatch.setattr(token_align, "AT_ONCE", limits[1])
    texts = [t for t in TEXTS if t and "▁" not in t]
    seen = 0
    for start, _, whole, x in token_align._aligned(A, B)(pa.array(texts)):
        assert whole.tolist() == list(range(len(whole)))
        seen += len(whole)
        ranges = [[(e - n, e) for e, n in zip(end.tolist(), np.diff(end, prepend=0).tolist(), strict=True)] for end in (x.a_end, x.b_end)]
        both = {(i, j): min(p[1], q[1]) - max(p[0], q[0]) for i, p in enumerate(ranges[0]) for j, q in enumerate(ranges[1]) if min(p[1], q[1]) > max(p[0], q[0])}
        assert dict(zip(zip(x.overlaps[0].tolist(), x.overlaps[1].tolist(), strict=True), x.overlaps[2].tolist(), strict=True)) == both
        group = [np.searchsorted(x.ends, e).tolist() for e in (x.a_end, x.b_end)]
        shared = [(i, j) for r, c, v in x.shared_groups() for i, j, k in zip(r.tolist(), c.tolist(), v.tolist(), strict=True) if k == 1]
        assert shared == [(i, j) for i, g in enumerate(group[0]) for j, h in enumerate(group[1]) if g == h]
    assert seen == len(texts)


def test_incidence_has_a_column_per_run_and_strings_are_verified_once():
    """One column per byte made four times the entries; texts were joined again for each occurrence of a string."""
    one = token_align.tokenizer(A)
    ids, whole = one.arrays(TEXTS[:2] + TEXTS[3:])
    for x, sure, t in zip(ids, whole, TEXTS[:2] + TEXTS[3:], strict=True):
        assert x.dtype == np.int32 and sure == one.gives_back(x, t)
    size = np.array([2, 3])
    m = token_align.incidence(np.array([1, 2]), size)
    assert m.columns == 2 and m.indptr.tolist() == [0, 1, 2] and m.data.tolist() == [2, 3]
    one.known, kept = {" ab": np.array([1], np.int32).tobytes()}, one.known
    one.lossy, before = {" ab"}, one.lossy
    try:
        assert one.arrays(["ab"])[1] == [False]
    finally:
        one.known, one.lossy = kept, before


def test_pairs_are_kept_in_four_bytes(spark, monkeypatch):
    """Of eight bytes each they were the largest column that the last pass moves."""
    assert token_align.pair_kind(1 << 32) == "<u4" and token_align.pair_kind((1 << 32) + 1) == "<i8"
    rows, kept = [(1, "plain words"), (2, "other words, plain")], []
    stored = token_align.stored
    monkeypatch.setattr(token_align, "stored", lambda df, *name: kept.append(stored(df, *name)) or kept[0])
    got = token_align.alignment_digests(docs(spark, rows), A, B).collect()
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got), key=str) == align_brute(rows)
    assert all(len(r.pairs) == 4 * r.n_links for r in kept[0].collect())


def test_words_in_runs_give_their_own_ids(monkeypatch):
    """Each new word was a text of its own for the tokenizer."""
    monkeypatch.setattr(token_align, "MEMORY", 100)
    rnd = random.Random(8)
    words = [" " + "".join(rnd.choice("abcdeéß日ﬁ") for _ in range(rnd.randint(1, 12))) for _ in range(500)]
    one = token_align.ByteLevel(A)
    one._learn_words(list(dict.fromkeys(words)))
    assert len(one.known) == len(set(words))
    for x, ids in one.known.items():
        assert np.frombuffer(ids, np.int32).tolist() == one.tokenizer.encode(x, add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts_by_both(monkeypatch):
    """Every text was encoded anew by the second tokenizer, and cut by a pattern for the first."""
    monkeypatch.setattr(token_align, "PIECES", 3000)
    rnd = random.Random(6)
    alphabet = [*"abcdefgXYZ019.,'-|<>/é ß日😀\u2028\u00a0\u0301\u180e\x00▁", *" " * 9, "  ", "\n", "\n", "\t", "\r\n", "the ", " ing", "<s>", "<0x0A>", "<|endoftext|>", "'re", "\u3000", ". ", ",\n"]
    texts = TEXTS[:2] + TEXTS[3:] + ["".join(rnd.choice(alphabet[: rnd.choice((20, 60, 99))]) for _ in range(rnd.randint(0, 60))) for _ in range(6000)]
    plain = [" ".join("".join(rnd.choice("abcdeéß.,'日1") for _ in range(rnd.randint(1, 8))) for _ in range(20)).replace(" b", "\nb") for _ in range(800)]
    both = token_align.Together(token_align.tokenizer(A), token_align.tokenizer(B))
    assert both.splits
    for part in (texts[:3000], texts[3000:], plain[:400], plain[400:], []):
        (a, whole_a), (b, whole_b) = both.arrays(part)
        assert [x.tolist() for x in a] == [e.ids for e in both.sides[0].tokenizer.encode_batch([" " + t for t in part], add_special_tokens=False)]
        for x, whole, y, t in zip(b, whole_b, both.sides[1].encode(part), part, strict=True):
            assert whole == (b"".join(both.sides[1].bytes[i] for i in y) == b" " + t.encode())
            assert x.tolist() == y
        assert all(whole_a)
    # pieces that are known reach no tokenizer again
    monkeypatch.setattr(token_align, "PIECES", 1 << 30)
    before = both.arrays(plain)
    monkeypatch.setattr(token_align.Pieces, "encode", lambda self, texts: pytest.fail("encoded again") if texts else [])
    again = both.arrays(plain[::-1])
    assert [[x.tolist() for x in ids] for ids, _ in again] == [[x.tolist() for x in ids[::-1]] for ids, _ in before]


def test_row_products_equal_dense_ones(monkeypatch):
    monkeypatch.setattr(token_align, "AT_ONCE", 5)
    rnd = np.random.default_rng(3)
    x, y = rnd.integers(0, 3, (9, 7)), rnd.integers(0, 3, (7, 8))
    csr = lambda m: token_align.Csr(np.concatenate([[0], np.cumsum((m > 0).sum(axis=1))]), np.nonzero(m)[1], m[m > 0], m.shape[1])
    got = np.zeros((9, 8), int)
    for r, c, v in token_align.row_products(csr(x), csr(y).transposed().transposed()):
        got[r, c] += v
    assert (got == x @ y).all()


def test_alignment_table(spark):
    row = token_align.alignments(docs(spark, [(1, "tokenization aligns"), (2, None)]), A, B).orderBy("doc_id").collect()
    assert sum(row[0].a_groups) == len(row[0].a_ids) and sum(row[0].b_groups) == len(row[0].b_ids) and len(row[0].links) == len(row[0].a_groups)
    assert sum(o["bytes"] for o in row[0].overlaps) == len(" tokenization aligns") and row[1].a_ids == []


# --------------------------------------------------------------- spelling


def variants_brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: m for w, m in n.items() if m >= 3 and len(w) >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    of = {w: [x for x in words if near(w, x)] for w in words}
    form = {w: f for w, xs in of.items() if xs and words[f := min(xs, key=lambda x: (-words[x], x))] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), m, len(of[w]), words.get(form.get(w))) for w, m in words.items()), key=str)


def misspelt(seed, alphabet):
    rnd = random.Random(seed)
    bases = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(4, 14))) for _ in range(60)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(120):
            w = list(rnd.choice(bases[: rnd.randint(1, len(bases))]))
            for _ in range(rnd.choice([0, 0, 0, 1, 2])):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randint(0, 1)] = [rnd.choice(alphabet)] * rnd.randint(0, 1)
            words.append("".join(w).title() if rnd.random() < 0.2 else "".join(w))
        rows.append((i if i % 7 else None, rnd.choice([" ", ", ", "-1"]).join(words)))
    return rows


@pytest.mark.parametrize(("alphabet", "limits"), [("abcdefgh", (100_000, 32, 20_000)), ("abé", (100_000, 32, 20_000)), ("abcdeÿ", (3, 1, 4)), ("ab", (1000, 2, 50))])
def test_spelling_variants_equal_brute_force(spark, monkeypatch, alphabet, limits):
    for name, value in zip(("MOST_FREQUENT", "LEAST_FREQUENT", "LONG_LIST"), limits, strict=True):
        monkeypatch.setattr(spelling, name, value)
    monkeypatch.setattr(spelling, "AT_ONCE", 64)
    long = "abcdefghij" * 30
    rows = misspelt(len(alphabet), alphabet) + [(900, None), (901, ""), (902, "1 2 ß×x"), (903, f"{long} " * 6 + f"{long[:70]}y{long[70:]} " * 3 + f"{long}z " * 3)]
    got = spelling.spelling_variants(docs(spark, rows)).collect()
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got), key=str) == variants_brute(rows)


def test_roots_of_long_chains(spark):
    words = ["z" * i + "abcdefghij"[i:] for i in range(10)]
    rows = [(i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(words)]
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(docs(spark, rows)).collect()}
    assert got == {w: (words[i + 1] if i < 9 else None, words[9]) for i, w in enumerate(words)}
    assert got == {w: (f, r) for w, f, r, *_ in variants_brute(rows)}


def test_near_words_about_the_width_of_the_table(spark):
    rnd = random.Random(6)
    rows = []
    for size in range(spelling.WIDEST - 2, spelling.WIDEST + 4):
        word = "".join(rnd.choice("abcdef") for _ in range(size))
        for at in (3, size // 2, size - 2):
            rows.append((len(rows), f"{word} " * 7 + f"{word[:at]}{word[at + 1:]} " * 3 + f"{word[:at]}x{word[at:]} " * 3 + f"{word[:at]}y{word[at + 1:]} " * 3))
    got = spelling.spelling_variants(docs(spark, rows)).collect()
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got), key=str) == variants_brute(rows)


def test_spelling_variants_of_nothing(spark):
    assert spelling.spelling_variants(docs(spark, [])).count() == 0
    assert spelling.spelling_variants(docs(spark, [(1, "word word"), (2, None)])).count() == 0


def test_near_words_share_a_list():
    """The bound of affected grams, over all edits of random words, at any set of frequent grams."""
    rnd = random.Random(8)
    for _ in range(400):
        alphabet = rnd.choice(["ab", "abcd", "abcdefghijk"])
        word = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(5, 12)))
        other = list(word)
        at = rnd.randrange(len(word) + 1)
        kind = rnd.choice("ird") if len(word) > 5 else rnd.choice("ir")
        other[at : at + (kind != "i")] = [] if kind == "d" else [rnd.choice(alphabet)]
        other = "".join(other)
        if other == word or len(other) < 5:
            continue
        text = "".join(rnd.choice(alphabet + spelling.BEGIN + spelling.END) for _ in range(60)) + word + other
        frequent = {text[i : i + q]: rnd.randint(1, 9) for q in (2, 3, 4, 5) for i in range(len(text)) if rnd.random() < 0.7}
        lists = [{k for m in spelling.schemes(len(w)) for k in spelling.lists_of(w, frequent, m)} for w in (word, other)]
        assert lists[0] & lists[1], (word, other)


def test_texts_are_hashed_in_small_runs():
    """Runs of two megabytes took 40 times as much while their words were made, in every worker."""
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(400)) for _ in range(2000)]
    array = pa.array(texts, pa.large_string())
    list(hashing.shingle_sets(array.slice(0, 300), 5))  # tables that stay
    tracemalloc.start()
    try:
        sizes = [len(s) for _, s in hashing.shingle_sets(array, 5)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sizes == [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for w in map(str.split, texts)]
    assert peak < 50e6


def test_free_memory_goes_back_after_shingles():
    """What earlier tasks of a worker had freed stayed with it."""
    held = lambda: int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024  # noqa: E731, SIM115
    arrays = [np.ones(12_000) for _ in range(2000)]  # below the size from which the C library maps arrays one by one
    kept = arrays[-1]
    del arrays
    before = held()
    assert [len(s) for _, s in hashing.shingle_sets(pa.array(["a b c", None]), 2)] == [2, 0]
    assert held() < before - 100 and kept[0] == 1


def test_hashing_shingles_drops_what_tokenizers_keep():
    """A worker kept their memory while it hashed shingles for other stages."""
    one, ids = token_align.tokenizer(A), token_align.together(A, B).arrays(["ab cd"])
    assert token_align.tokenizer(A) is one
    list(hashing.shingle_sets(pa.array(["a b c"]), 2))
    assert token_align.tokenizer(A) is not one
    assert str(token_align.together(A, B).arrays(["ab cd"])) == str(ids)
