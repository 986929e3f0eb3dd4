"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshift.session import scratch_path

#: ASCII white space as the operators use it: space and U+0009 to U+000D.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """SHA-256 of the text: with the id it tells rows apart that share an id, or have none."""
    return F.sha2(text_of(column).cast("binary"), 256)


def row_key(docs: DataFrame) -> Column:
    """SHA-256 of a whole row: rows that agree in it are copies of each other in every column."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return F.unhex(F.sha2(F.concat(text_key(), F.to_json(F.struct(F.lit(0).alias("0"), *others))), 256))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores put before those that ``docs`` has a column of."""
    used = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in used:
            name = f"_{name}"
        out.append(name)
    return out


def stored(df: DataFrame, *name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` below the session's shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, in a columnar file that any executor can read
    again, so that a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", *name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
