"""The corpus pipeline on a small input: every stage's decisions against the operator that makes them."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lakeshift.llm import decontaminate, mixing, ngram_join, quality_lm
from lakeshift.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, scratch):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{scratch}/{k}")
        out = spark.read.parquet(f"{scratch}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        seen[name] = (docs, out)
        docs = out
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    before, after = seen["quality"]
    rejected = ids(quality_lm.score_quality(before, table(spark, SF, "labels")).filter("not kept"))
    assert ids(after) == ids(before) - rejected

    before, after = seen["near_duplicates"]
    groups = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(before, 5, 80).collect()}
    assert ids(after) == {c for _, c in groups} and after.count() == len(ids(after))

    before, after = seen["decontaminate"]
    assert ids(before) - ids(after) == ids(decontaminate.find_contamination(before, table(spark, SF, "benchmark")))

    before, after = seen["mix"]
    taken = mixing.plan_mix(before).groupBy("source").sum("taken").collect()
    words = after.select("source", mixing.n_words(after["text"]).alias("n")).groupBy("source").sum("n").collect()
    assert sorted(map(tuple, taken)) == sorted(map(tuple, words))

    before, after = seen["tokens"]
    assert after.count() == before.count() and after.agg({"n_tokens": "sum"}).first()[0] == max(r["start"] + r["n_tokens"] for r in after.collect())


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]


def test_rows_that_share_an_id_or_have_none_are_decided_by_themselves(spark):
    row = lambda i, t: (i, t, "en", "s", len(t or ""))
    texts = [" ".join(f"{w}{n}" for w in "abcdefghij") for n in range(5)]
    table_of = lambda rows: spark.createDataFrame([row(*r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    # different documents stay, of each group one row: the least id's, null last, and of its rows the least text
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[2]), (7, texts[3]), (4, texts[3]), (9, texts[4] + " x"), (9, texts[4]), (None, None), (None, "")]
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (4, texts[3]), (9, texts[4]), (None, None), (None, "")]
    assert got(ngram_join.keep_one(table_of(rows))) == sorted(want, key=str)

    # one contaminated row takes no other with it
    items = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    rows = [(None, "so " + texts[0]), (None, texts[1]), (7, texts[0].upper()), (7, texts[2]), (None, None)]
    assert got(decontaminate.remove_contaminated(table_of(rows), items)) == sorted([(None, texts[1]), (7, texts[2]), (None, None)], key=str)

    # nor does a rejected one
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["an", "er", "ti", "on", "the", "st", "ou", "re"]) for _ in range(rnd.randint(1, 4)))
    clean = [" ".join(word() for _ in range(rnd.randint(20, 120))) for _ in range(300)]
    junk = [" ".join(word() + rnd.choice(["***", "%%%", "&&&"]) for _ in range(60)) for _ in range(2)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = [*enumerate(clean), (None, clean[5]), (None, clean[8]), (None, junk[0]), (400, clean[9]), (400, junk[1])]
    kept = got(quality_lm.keep_quality(table_of(rows), labels))
    assert {t for _, t in kept}.isdisjoint(junk) and (400, clean[9]) in kept and (None, clean[5]) in kept and (None, clean[8]) in kept


def test_extra_columns_with_clashing_names(spark, scratch):
    """Every stage but the last returns extra columns as they came, whatever they are called."""
    import corpus_pipeline

    names = ["_id", "_digest", "_label", "_first", "_text", "_row", "_bad", "_lang", "_size", "_words", "_taken", "_n", "digest", "label", "node", "chunk", "size", "row", "key", "slice", "best"]
    sf = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    wide = plain.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    wide = wide.unionByName(wide.limit(1))
    wide.write.parquet(f"{scratch}/wide")
    wide = spark.read.parquet(f"{scratch}/wide")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf).count() == 61


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_goes_moves_no_text_of_what_stays(spark, monkeypatch):
    texts = [" ".join(f"{w}{n}" for w in "abcdefghij") for n in range(5)]
    rows = [(None, texts[0], "en"), (None, texts[1], "en"), (7, texts[0], None), (7, texts[2], None), (7, texts[2], "de"), (8, None, "de"), (9, "", None)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    items = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    scores = [(None, texts[1], "en", False), (7, texts[2], None, False), (8, None, "de", False), (9, "", None, True)]
    scored = spark.createDataFrame(scores, "doc_id long, text string, lang string, kept boolean").withColumn("digest", ngram_join.text_key())
    monkeypatch.setattr(quality_lm, "score_quality", lambda *a, **b: scored)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as it is when many rows go
    try:
        got = {}
        for name, kept in (("clean", decontaminate.remove_contaminated(docs, items)), ("good", quality_lm.keep_quality(docs, None))):
            assert kept.columns == docs.columns and "BroadcastHashJoin" in plan_of(kept)
            got[name] = sorted(((r["doc_id"], r["text"], r["lang"]) for r in kept.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert got["clean"] == sorted([r for r in rows if r[1] != texts[0]], key=str)
    assert got["good"] == sorted([rows[i] for i in (0, 2, 4, 6)], key=str)


def test_stages_start_no_python_workers_beside_those_of_their_operators(spark):
    docs = table(spark, SF, "documents").limit(5)
    digests = corpus_pipeline.tokens(spark, docs, SF)
    found = decontaminate.find_contamination(docs, table(spark, SF, "benchmark"))
    none = decontaminate.find_contamination(docs, table(spark, SF, "benchmark").limit(0))
    assert not [df for df in (digests, found, none) if "ExistingRDD" in plan_of(df)]
    assert none.count() == 0 and none.schema == found.schema
