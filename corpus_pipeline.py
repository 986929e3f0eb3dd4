"""The corpus pipeline: five operators in a row over ``documents``.

1. ``quality`` (10): documents that the Kneser-Ney classifier rejects go.
2. ``near_duplicates`` (5): one document of each group of similar ones (five words, similarity 0.8) stays.
3. ``decontaminate`` (8): documents that contain a benchmark item go.
4. ``mix`` (4): sources are cut or repeated to their targets; a repeated document stands several times.
5. ``tokens`` (9): the mixture is written as Huffman-coded token blocks and read back.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeshift.llm.common import stored, table
from lakeshift.llm.decontaminate import remove_contaminated
from lakeshift.llm.mixing import mix
from lakeshift.llm.ngram_join import keep_one
from lakeshift.llm.quality_lm import keep_quality
from lakeshift.llm.token_output import token_digests


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, k=5, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix_sources), ("tokens", tokens)]

#: SQL can express neither the language model nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stored(stage(spark, out, sf_dir), "pipeline", name)
    return STAGES[-1][1](spark, out, sf_dir)
