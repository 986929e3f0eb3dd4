"""Extraction, toxicity, joins, decontamination, token output and the language model against brute force."""

import random
import re
import zlib

import numpy as np
import pytest

from lakeshift.llm import decontaminate, html_extract, huffman, linking, ngram_join, quality_lm, token_output, toxicity
from lakeshift.llm.components import components
from lakeshift.llm.html_blocks import blocks

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, label int, h int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "n", 1, 2) for i, t in rows], DOCS)


# ------------------------------------------------------------------ pages


def text_of(html):
    return [t for zone, t in blocks(html) if zone == "article"]


def test_blocks_of_an_article():
    html = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header>no</header>
    <nav><ul><li><a>no</a></li></ul></nav><!-- no --><div class="ad">no</div><div id="cookie-notice">no</div>
    <article class="post"><header><h1>Title &amp; more</h1></header><p>one <b>bold
    text</b>&nbsp;<i>it</i><br>two<p>three &lt;x&gt; &#233;</p><div class="share-bar">no</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
    <form><label>no</label><textarea>no</textarea></form><aside>no</aside><section id="comments"><p>no</p></section><p hidden>no</p><p>last</article>
    <aside>no</aside><footer>&copy; no</footer></body></html>"""
    assert text_of(html) == ["Title & more", "one bold text it two", "three <x> é", "a", "b", "c", "d", "last"]


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<!--", "<article><script>x", "&#xD800;", "</p></p>", "<article>" + "<div>" * 3000])
def test_broken_markup_has_a_result(html):
    assert text_of(html) in ([], ["x"])


def test_an_article_inside_main_and_articles_that_are_comments():
    html = '<main><p>crumbs</p><article class="long-form main-nav"><p>a</p><article class="comment"><p>no</p></article></article></main>'
    assert text_of(html) == ["a"] and [t for zone, t in blocks("<main><p>b</p><div class=sidebar>no</div></main>") if zone == "main"] == ["b"]


def test_unclosed_inline_does_not_swallow_the_rest():
    assert text_of("<article><p><b>a <br><p>b</article><p>c") == ["a", "b"]


def test_hosts_drop_what_repeats(spark):
    menu = "home news sport weather about us contact the team now"
    pages = [(i, f"http://h.net/{i}", f"<body><p>{menu}</p><p>unique words of page {i} that nobody else has {i * 7}</p></body>") for i in range(4)]
    pages += [(10, "http://other.net/", f"<body><p>{menu}</p></body>"), (11, None, None), (12, "http://h.net/12", f"<nav>x</nav><article><p>{menu}</p></article>"), (12, "http://h.net/12", "")]
    df = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_text(df).collect())
    want = [(i, f"unique words of page {i} that nobody else has {i * 7}") for i in range(4)] + [(10, menu), (11, ""), (12, ""), (12, menu)]
    assert got == sorted((i, t, len(t)) for i, t in want)
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_copies_of_a_page_are_one_content_and_articles_stay_whole(spark):
    story = "a story without any article element that stands whole under many addresses of one host"
    line = "all our offices are open on every weekday from nine"
    pages = [(i, f"http://c.net/{i}", f"<body><div class=ad>advert {i}</div><p>{story}</p></body>") for i in range(5)]
    pages += [(20 + i, f"http://d.net/{i}", f"<body><footer>{line}</footer><article><p>text of page {i}</p></article></body>") for i in range(3)]
    quoted = f"they say that {line} but nobody came"
    pages += [(30, "http://d.net/x", f"<article><p>Offices</p><p>{line}</p><p>{quoted}</p></article>"), (31, "http://e.net/x", f"<article><p>{line}</p></article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(df).collect()}
    assert got == {**dict.fromkeys(range(5), story), **{20 + i: f"text of page {i}" for i in range(3)}, 30: f"Offices\n{line}\n{quoted}", 31: line}


def test_a_line_in_most_articles_of_a_host_is_a_notice(spark):
    notice = "you have read two of your five free stories this month so join us today"
    shared = "all rights are with the writers of this page and with nobody else at all"
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    page = lambda i, *blocks: (i, f"http://n.net/{i}", "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>")
    pages = [page(i, body(i), *([notice] if i else []), f"{notice} they wrote on page {i}", *([shared] if i % 2 else []), "end") for i in range(12)]
    # near copies stay whole, and so do the articles of a host with few contents
    copies = [(100 + i, f"http://copies.net/{i}", f"<article><p>{body(500)}</p><p>copy {i}</p></article>") for i in range(12)]
    few = [(200 + i, f"http://few.net/{i}", f"<article><p>{body(i)}</p><p>{notice}</p></article>") for i in range(9)]
    df = spark.createDataFrame(pages + copies + few, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_text(df.repartition(5)).collect()}
    want = {i: "\n".join([body(i), f"{notice} they wrote on page {i}", *([shared] if i % 2 else []), "end"]) for i in range(12)}
    want |= {100 + i: f"{body(500)}\ncopy {i}" for i in range(12)} | {200 + i: f"{body(i)}\n{notice}" for i in range(9)}
    assert got == {i: (t, len(t)) for i, t in want.items()}


# --------------------------------------------------------------- toxicity


def test_toxicity_on_held_out_documents(spark):
    rnd = random.Random(5)
    plain = ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(3, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1200):
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        bad = i % 6 == 0
        for _ in range(rnd.randint(1, 3) if bad else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["zorkish", "zorkan", "You quaffle", "MURKLE!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None), (5001, ""), (None, "zorkish"), (5002, "x " * 40000)]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs(spark, rows), lab).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] for i in held) and sum(r["held_out"] for r in out.values() if r["doc_id"] in range(1200)) == len(held)
    assert sum(out[i]["predicted"] == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert out[5000]["score"] == out[5001]["score"] and out[None]["predicted"] == 1
    none = toxicity.score_toxicity(docs(spark, rows[:3]), lab.limit(0)).collect()
    assert [r["predicted"] for r in none] == [0, 0, 0]
    assert toxicity.score_toxicity(docs(spark, []), lab).count() == 0


def test_a_rare_insult_is_learned_beside_many_copies(spark):
    rnd = random.Random(6)
    plain = ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(3, 7))) for _ in range(400)]
    some = lambda *extra: " ".join([*extra, *rnd.choices(plain, k=rnd.randint(5, 60))])
    copied = "zorkish " + " ".join(f"only{x}here" for x in plain[:20])
    learned = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = [some() for _ in range(600)] + [some("zorkish") for _ in range(200)] + [copied] * 400 + [some("quabble") for _ in range(10)]
    rows = list(zip(learned, texts, strict=False))
    labels = spark.createDataFrame([(i, 1, int("zorkish" in t or "quabble" in t)) for i, t in rows], "doc_id long, quality int, toxic int")
    new = [(5000 + i, some("quabble")) for i in range(5)] + [(6000, copied.replace("zorkish", "")), (6001, some())]
    out = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs(spark, rows + new), labels).collect()}
    assert [out[i] for i, _ in new] == [1] * 5 + [0, 0]


def test_grammar_marks_the_clause():
    g = toxicity.Grammar({"^idiot$": 2.0, "^moro": 1.5})
    name = lambda t: {toxicity.FEATURES[k] for k in np.flatnonzero(g.features(t)[:8])}
    assert name("What an idiot. Nice day") == {"insult_plain"}
    assert name("You are an idiot") == {"insult_target"}
    assert name("you are not an idiot; fine") == {"insult_negated"}
    assert name('He said: "moronic"') == {"insult_reported"}
    assert name("I will kill you") == {"threat_target"}
    assert name("not. an idiot") == {"insult_plain"}
    assert name("no word here") == set()


# ------------------------------------------------------------------- join


def sets_brute(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def join_brute(rows, k, threshold):
    sets = [(i, sets_brute(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, s) in enumerate(sets):
        if s:
            least[root(a)] = min([j for j in (least.get(root(a)), i) if j is not None], default=None)
    return sorted(((i, len(s), least[root(a)] if s else i) for a, (i, s) in enumerate(sets)), key=str)


def near_copies(seed, groups, length):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyz") + str(rnd.randint(0, 30))
    shared = [word() for _ in range(40)]
    rows, i = [], 0
    for g in range(groups):
        base = [word() for _ in range(rnd.randint(3, length))]
        if g % 3 == 0:
            base[2:2] = shared
        for _ in range(rnd.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((i := i + rnd.randint(1, 3), rnd.choice([" ", "\n", " \t "]).join(copy).replace("a", "A" if rnd.random() < 0.3 else "a")))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "threshold", "limits"), [(3, 90, (64, 500, 256)), (3, 90, (3, 60, 4)), (5, 80, (2, 30, 3))])
def test_join_equals_brute_force(spark, monkeypatch, k, threshold, limits):
    for name, value in zip(("RARE", "LONG", "CHUNK_TOKENS", "SHARD_TOKENS"), (*limits[:2], 4000, 5000), strict=True):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(linking, "BLOCK", limits[2])
    monkeypatch.setattr(linking, "WIDE", limits[2] + 1)
    rows = near_copies(k + limits[0], 28, 150) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A  b"), (9005, "a"), (9006, "a b c d e f g h i j"), (9006, "q r s t u v"), (None, "lone words here and there")]
    got = [tuple(r) for r in ngram_join.jaccard_components(docs(spark, rows), k, threshold).collect()]
    assert sorted(got, key=str) == join_brute(rows, k, threshold)


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_keep_one(spark, monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "FILTER_BITS", bits)
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (8, "x y z"), (8, "x y z"), (9, None), (10, ""), (None, "n o p")]
    kept = ngram_join.keep_one(docs(spark, rows))
    got = sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    assert got == sorted(map(str, [(3, "A b c d e f g"), (8, "x y z"), (9, None), (10, ""), (None, "n o p")]))
    assert kept.columns == docs(spark, []).columns and ngram_join.keep_one(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(docs(spark, rows), 3, 50)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# -------------------------------------------------------- decontamination


def contains_brute(rows, items, k, threshold):
    words = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    grams = lambda w, m: frozenset(tuple(w[i : i + m]) for i in range(len(w) - m + 1)) if m else frozenset()
    out = []
    for i, t in rows:
        for j, u in items:
            m = min(k, len(words(u)))  # an item of fewer words is looked for at its own length
            have, want = grams(words(t), m), grams(words(u), m)
            if want and len(want & have) >= threshold * len(want) - 1e-9:
                out.append((i, j, len(want), len(want & have)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16_000_000, 300])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdé") + str(rnd.randint(0, 400))
    items = [(j, " ".join(word() for _ in range(rnd.randint(1, 40)))) for j in range(30)] + [(70, None), (71, ""), (72, "...")]
    rows = [(50, None), (51, ""), (None, items[3][1])]
    for i in range(50):
        w = [word() for _ in range(rnd.randint(0, 400))]
        for j in rnd.sample(range(30), 2):
            copy = items[j][1].split()
            for _ in range(rnd.randint(0, 1 + len(copy) // 12)):
                copy[rnd.randrange(len(copy))] = word()
            at = rnd.randint(0, len(w))
            w[at:at] = copy
        rows.append((i, rnd.choice([" ", ", ", "\n- "]).join(w).upper() if i % 4 == 0 else " ".join(w)))
    df, bench = docs(spark, rows), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"]) for r in decontaminate.find_contamination(df, bench).collect()), key=str)
    want = contains_brute(rows, items, 5, 0.8)
    assert got == want and len(want) > 20
    kept = decontaminate.remove_contaminated(df, bench)
    bad = {i for i, *_ in want}
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in bad)
    assert decontaminate.find_contamination(df, bench.limit(0)).count() == 0 and decontaminate.find_contamination(df.limit(0), bench).count() == 0


def test_short_items_inside_long_documents(spark):
    items = spark.createDataFrame([(1, "Capital of France is"), (2, "zyx"), (3, "of France"), (4, "one two three four five")], "item_id long, text string")
    rows = [(1, "the capital, of france IS paris and more words"), (2, "capital of spain is"), (3, "France"), (4, "zyx"), (5, "a b zyxw c"), (6, "four of france one two three four five zyx")]
    got = decontaminate.find_contamination(docs(spark, rows), items)
    assert sorted((r["doc_id"], r["item_id"], r["n_item_shingles"], r["containment"]) for r in got.collect()) == [(1, 1, 1, 1.0), (1, 3, 1, 1.0), (4, 2, 1, 1.0), (6, 2, 1, 1.0), (6, 3, 1, 1.0), (6, 4, 1, 1.0)]


def test_what_is_broadcast_needs_no_package():
    import pickletools
    import pickle

    sent = pickle.dumps(decontaminate._by_length([1, 2], ["a b", "a b c d e f g"], 5, 0.8))
    assert not [a for _, a, _ in pickletools.genops(sent) if isinstance(a, str) and "lakeshift" in a]


# ----------------------------------------------------------- token output


@pytest.mark.parametrize(("n", "bits"), [(1, 16), (2, 16), (5, 3), (300, 9), (300, 16), (5000, 13)])
def test_huffman_round_trip(n, bits):
    rnd = np.random.default_rng(n)
    counts = np.maximum(1, (1e7 / np.arange(1, n + 1) ** 2.2)).astype(np.int64)
    rnd.shuffle(counts)
    lengths = huffman.code_lengths(counts, bits)
    assert lengths.max() <= bits and (n < 2 or (0.5 ** lengths.astype(float)).sum() == 1)
    symbols = np.sort(rnd.choice(60000, n, replace=False))
    code = huffman.Code(symbols, lengths)
    sizes = np.array([1, 0, 63, 64, 65, 1000, 7])
    ids = rnd.choice(symbols, sizes.sum(), p=counts / counts.sum())
    data, n_bytes, offsets, lanes = code.encode(ids, sizes)
    assert len(data) == n_bytes.sum() and len(offsets) == lanes.sum()
    base = np.repeat((np.cumsum(n_bytes) - n_bytes) * 8, lanes)
    assert np.array_equal(code.decode(data.tobytes(), offsets + base, sizes), ids)


def test_code_lengths_are_optimal():
    assert sorted(huffman.code_lengths(np.array([1, 1, 2, 4, 8]), 16)) == [1, 2, 3, 4, 4]
    assert sorted(huffman.code_lengths(np.array([1, 1, 2, 4, 8]), 3)) == [1, 3, 3, 3, 3]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_equal_the_tokenizer(spark, monkeypatch, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "BLOCK_IDS", 200)
    texts = [
        None, "", " ", "Hello, world! don't you'll 's ''s '", "ÀÉ ß ÿ × ÷ ŉ İstanbul ς Σ", "e\u0301 \u212b \u3000 x\u00a0y \x1c z", "<|endoftext|> a<|startoftext|>b <| |>", "12 3a4 ½ ٣", "日本語 テキスト 😀👍🏽", "word " * 3000, "x" * 5000, "a\tb\nc\x0bd\x0ce\rf",
        "THE Quick brown-fox *** $$$%%% ###",
    ]
    rows = [(i * 7 % 13, t) for i, t in enumerate(texts)] + [(3, "twice"), (3, "again"), (None, "no id")]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    if name.startswith("byte"):  # pieces of a byte-level tokenizer carry the space before them: only white-space-free texts keep their ids
        rows = [(i, x) for i, x in rows if x and len(x.split()) == 1 and x == x.strip()]
    got = {}
    for r in token_output.token_digests(docs(spark, rows), public_tokenizers.path(name), 2).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    ids = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
    want = {}
    for i, x in rows:
        want.setdefault(i, []).append((len(ids(x)), zlib.crc32(ids(x).tobytes())))
    assert {i: sorted(v[1:] for v in vs) for i, vs in got.items()} == {i: sorted(v) for i, v in want.items()}
    at = 0
    for i in sorted(got, key=lambda i: (i is not None, i or 0)):
        for start, n, _ in sorted(got[i]):
            assert start == at
            at += n
    assert token_output.token_digests(docs(spark, []), public_tokenizers.path(name), 2).count() == 0


# --------------------------------------------------------- language model


def kn_brute(texts, order):
    """Probabilities of the highest order and weights, straight from the definition."""
    grams = {}
    for t in texts:
        b = b"\n" * (order - 1) + t.encode()
        for i in range(order - 1, len(b)):
            g = b[i - order + 1 : i + 1]
            grams[g] = grams.get(g, 0) + 1
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        low = {}
        for g in levels[n + 1]:
            low[g[1:]] = low.get(g[1:], 0) + 1
        levels[n] = low

    def discount(n, c):
        return quality_lm._discounts({i: sum(x == i for x in levels[n].values()) for i in (1, 2, 3, 4)})[min(c, 3) - 1]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        followers = {x: c for x, c in levels[n].items() if x[:-1] == g[:-1]}
        total = sum(followers.values())
        if not total:
            return p(g[1:])
        left = sum(discount(n, c) for c in followers.values()) / total
        c = levels[n].get(g, 0)
        return (c - discount(n, c) if c else 0) / total + left * p(g[1:])

    return p


def test_kneser_ney_equals_its_definition(spark, monkeypatch):
    monkeypatch.setattr(quality_lm, "CHUNK_BYTES", 300)
    monkeypatch.setattr(quality_lm, "SHARD_BYTES", 400)
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["the", "cat", "sat", "on", "é", "mat", "dog"]) for _ in range(12)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, "zzz qqq"), (101, ""), (102, None), (103, "cat sat")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(5, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_lm.score_quality(docs(spark, rows), labels, order=3).collect()}
    held = {r[0] for r in spark.range(30).selectExpr("id", "pmod(xxhash64('held', id), 10) = 0 AS h").filter("h").collect()}
    p = kn_brute([t for i, t in enumerate(texts) if i not in held and i != 5], 3)
    assert abs(sum(p(bytes([97, 116, c])) for c in range(256)) - 1) < 1e-9
    for i in (0, 7, 100, 103):
        b = b"\n\n" + dict(rows)[i].encode()
        loss = -sum(np.log(p(b[j - 2 : j + 1])) for j in range(2, len(b))) / (len(b) - 2)
        assert out[i]["perplexity"] == pytest.approx(np.exp(loss), rel=1e-4)
    assert out[101]["perplexity"] == out[102]["perplexity"] == 1 and out[101]["kept"] and out[102]["kept"]


def test_quality_rejects_junk_and_keeps_clean_text(spark):
    rnd = random.Random(4)
    syl = ["an", "er", "ti", "on", "the", "st", "ou", "re"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randint(1, 4)))
    clean = [" ".join(word() for _ in range(rnd.randint(20, 120))) for _ in range(300)]
    junk = [" ".join(word() + rnd.choice(["***", "%%%", "&&&"]) for _ in range(60)) for _ in range(10)] + [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(10)]
    rows = list(enumerate(clean + junk)) + [(None, "the on"), (3, "the an on")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows)
    kept = quality_lm.keep_quality(df, labels)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and not [i for i in ids if i is not None and i >= 300]
    assert len({i for i in ids if i is not None}) >= 297 and None in ids
    assert quality_lm.keep_quality(df, labels.limit(0)).count() == len(rows)
    assert quality_lm.score_quality(docs(spark, []), labels).count() == 0


def test_packed_keys_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**60, 1000, dtype=np.uint64))
    assert np.array_equal(quality_lm._widen(quality_lm._squeeze(keys), len(keys)), keys)
    k, sizes = quality_lm.byte_keys(["ab", "", "é"], 3)
    assert sizes.tolist() == [2, 0, 2] and k.tolist() == [0x0A0A61, 0x0A6162, 0x0A0AC3, 0x0AC3A9]
    assert quality_lm.byte_keys([], 3)[0].tolist() == []


def test_a_batch_becomes_strings_in_runs(monkeypatch):
    import sys
    import tracemalloc
    import types

    import pyarrow as pa

    encoder = types.SimpleNamespace(encode=lambda texts: (np.zeros(len(texts), np.uint32), np.ones(len(texts), np.int64)))
    monkeypatch.setitem(sys.modules, "_lakeshift_worker", types.SimpleNamespace(encoder=encoder, encoder_of=("t", 2)))
    n = 3000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(["word " * 1000] * (n - 1) + [None])], ["doc_id", "h", "text"])
    tracemalloc.start()
    out = list(token_output._tokenise("t", 2)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == n and peak < batch.nbytes / 2


def test_free_memory_of_arrow_goes_back(monkeypatch):
    import types

    from lakeshift.llm import hashing

    asked = []
    monkeypatch.setattr(hashing.pa, "default_memory_pool", lambda: types.SimpleNamespace(release_unused=lambda: asked.append(1)))
    hashing.hand_back()
    assert asked
