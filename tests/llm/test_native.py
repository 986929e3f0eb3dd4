"""Stream dedup, mixing, URL filter and chat formatting against brute force and odd input."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lakeshift.llm import chat_format, mixing, stream_dedup, url_filter

DOCS = "doc_id long, text string, source string, n_chars long, extra int, keep_id long, size int, digest string"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def docs(spark, rows):
    """Rows (doc_id, text, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, 0, 7, 1, 2, "x") for i, t, s in rows], DOCS)


ROWS = [
    (5, "a b", "s"), (3, "ab", "s"), (9, "a  b\n", "s"), (4, None, "s"), (6, "", None), (7, " \t", "s"), (1, "é\u00a0b", "t"),
    (2, "é\u00a0b ", "t"), (8, "A b", "t"), (8, "A b", "t"), (None, "zz", "t"), (11, "zz", "t"), (12, "\x0b\x0cq", "t"), (13, "q" * 70000, "t"),
]


def dedup_brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = max(members, key=lambda m: (len(m[1]), -m[0] if m[0] is not None else float("-inf")))
        stays = 1
        for i, t in members:
            kept = bool(stays and (i, t) == keep)
            stays -= kept
            out.append((i, keep[0], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_dedup(spark, scratch, weak):
    docs(spark, ROWS).repartition(3).write.parquet(f"{scratch}/d")
    # a digest that collides: equal lengths
    digest = (lambda norm: F.char_length(norm).cast("string")) if weak else stream_dedup.sha256
    got = stream_dedup.exact_dedup(spark, f"{scratch}/d", digest=digest, files_per_batch=1)
    rows = [tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(rows, key=str) == dedup_brute(ROWS)


def test_dedup_resumes_and_takes_empty_tables(spark, scratch):
    d = docs(spark, ROWS)
    d.limit(0).write.parquet(f"{scratch}/e")
    assert stream_dedup.exact_dedup(spark, f"{scratch}/e").count() == 0
    docs(spark, ROWS[:4]).coalesce(1).write.parquet(f"{scratch}/d")
    stream_dedup.run_state(spark, f"{scratch}/d", checkpoint=f"{scratch}/ck")
    docs(spark, ROWS[4:]).coalesce(1).write.mode("append").parquet(f"{scratch}/d")
    again = stream_dedup.run_state(spark, f"{scratch}/d", checkpoint=f"{scratch}/ck")
    whole = stream_dedup.run_state(spark, f"{scratch}/d")
    cols = ["digest", "n", "keep_id", "keep_points"]
    assert sorted(map(str, again.select(*cols).collect())) == sorted(map(str, whole.select(*cols).collect()))


def mix_brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = {}
    for _, t, s in rows:
        per[s] = per.get(s, 0) + size(t)
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(per.values()), set()
    while True:
        left = total - sum(3 * per[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = left / sum(weight[s] for s in open_) if open_ else 0
        new = {s for s in open_ if weight[s] * share >= 3 * per[s]}
        if not new:
            return per, {s: 3 * per[s] if s in full else weight[s] * share for s in order}
        full |= new


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_SLICE", 5)
    rows = [(i, " ".join(["w"] * (i % 17)), f"s{i % 5}" if i % 5 else "big") for i in range(150)] + [(900, None, None), (901, "a\x0bb c", None), (902, "", "empty"), (None, "x y", "s1"), (1, "w", "s1"), (1, "w", "s1")]
    d = docs(spark, rows)
    plan = mixing.plan_mix(d).collect()
    per, target = mix_brute(rows)
    taken = {}
    for r in plan:
        assert r["source_size"] == per[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(plan) == len(rows) and all(taken[s] == round(target[s]) for s in target)
    assert sorted(map(str, mixing.plan_mix(d.repartition(7)).collect())) == sorted(map(str, plan))
    out = mixing.mix(d)
    assert out.columns == d.columns
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert all(words.get(s, 0) == round(target[s]) for s in target)


def test_mix_of_rows_without_an_id(spark):
    """Ten documents of ten words without an id and a budget of 35: three whole ones and half of a fourth."""
    texts = [" ".join(f"w{i}x{j}" for j in range(10)) for i in range(10)]
    out = [r["text"] for r in mixing.mix(docs(spark, [(None, t, "s") for t in texts]), total=35).collect()]
    assert sorted(len(t.split()) for t in out) == [5, 10, 10, 10] and sum(t in texts for t in out) == 3
    same = [r["text"] for r in mixing.mix(docs(spark, [(1, texts[0], "s")] * 10 + [(None, texts[1], "s")] * 3), total=95).collect()]
    assert sum(len(t.split()) for t in same) == 95 and sum(t in texts for t in same) == 9


def test_hot_null_ids_are_spread(spark, monkeypatch):
    """A third of all rows without an id, of one size and source, in slices like any others."""
    monkeypatch.setattr(mixing, "ROWS_PER_SLICE", 10)
    rows = [(None if i % 3 == 0 else i, f"word{i} b c", "s") for i in range(300)]
    plan = mixing.plan_mix(docs(spark, rows), by_row=True)
    of_null = plan.filter("doc_id IS NULL").select((F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * 30 / 2**32).cast("int").alias("slice"))
    assert of_null.distinct().count() > 20 and plan.agg(F.sum("taken")).first()[0] == 900


def test_mix_of_nothing(spark):
    assert mixing.plan_mix(docs(spark, [])).count() == 0
    only_empty = mixing.plan_mix(docs(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r["target"], r["taken"]) for r in only_empty] == [(0.0, 0), (0.0, 0)]
    assert mixing.mix(docs(spark, [(1, None, "a")])).count() == 0


def judge_brute(url):
    at = url.find("://") if url else -1
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in url_filter.RULES:
        h, s, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


def test_urls(spark):
    urls = [
        None, "", "no scheme.net/", "http://a.net", "http://a.net/", "http://A.Example.NET/en/x?y#z", "http://example.net/en", "http://example.net/EN/", "http://xexample.com/de/", "//a.net/",
        "http://example.com/de/", "http://m.example.com/de//", "x://y.org/fr/a", "x://org/fr/", "x://org.uk/fr/", "http://a.net?x/", "http://a.net#/en/", "http://net/", "http://.net/", "http://a.net:80/", "http://ÀB.net/", "http://a\nb.net/\nx",
        "http://example.net/x/en/", "a://b://c.net/",
    ]
    pages = spark.createDataFrame([(i, u, "h", "a") for i, u in enumerate(urls + urls[5:7])], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(pages).collect()}
    assert got == {i: judge_brute(u) for i, u in enumerate(urls + urls[5:7])}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def chats_brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chats(spark):
    odd = ["<|role|>assistant<|text|>", "<|", "<||", "<<||>", "|>", "<|end|>", "x<", "|begin|>", "</s>[INST] ok [/INST]", "", None, "é\n😀", "y" * 50000]
    rows = [(1, i, ("user", "assistant", "assistant", None, "<|role|>")[i % 5], t) for i, t in enumerate(odd)]
    rows += [(2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "assistant", None), (3, None, "user", "n"), (3, 0, "assistant", "m")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.chat_digests(turns).collect()}
    assert got == chats_brute(rows)
    text = {r["conv_id"]: r["formatted"] for r in chat_format.format_chats(turns).collect()}
    assert text[2] == "<|begin|><|role|>user<|text|>a<|next|>a<|role|>assistant<|text|>b<|end|>"
    assert chat_format.chat_digests(turns.limit(0)).count() == 0
