"""Column lineage and schema facets of run-event documents, read as VARIANT because their keys are column names.

A facet names, per output column, its input fields with transformations.  An input field is ``exact`` with a DIRECT transformation and
``inferred`` without one; a column without input fields is ``lost``.  Text that is no JSON, and facets of another shape, are counted
instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import PRECISION_RANK, _label

_ROWS = "array<variant>"


def _text(v: Column | str, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _outputs(lines: DataFrame, column: str) -> DataFrame:
    """One row per output of a document; a document without outputs, or that is malformed, gives one with a NULL output."""
    doc = lines.filter(F.col(column).isNotNull()).select(F.try_parse_json(F.col(column)).alias("doc"))
    out = doc.select("doc", F.posexplode_outer(F.try_variant_get("doc", "$.outputs", _ROWS)).alias("at", "out"))
    job = [_text("doc", "$.job.namespace").alias("job_ns"), _text("doc", "$.job.name").alias("job_name")]
    fields = F.try_variant_get("out", "$.facets.columnLineage.fields", "map<string,variant>")
    return out.select(*job, F.col("doc").isNull().alias("malformed"), (F.coalesce("at", F.lit(0)) == 0).alias("first"), "out", fields.alias("fields"))


def facet_column_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """``job_ns, job_name, out_ns, out_name, out_col, in_ns, in_name, in_col, precision, n_claims``: each column edge that documents of a job
    claim, with the best precision claimed.  A column claimed without input fields has an edge with NULL inputs."""
    out = _outputs(lines, column).select("job_ns", "job_name", _text("out", "$.namespace").alias("out_ns"), _text("out", "$.name").alias("out_name"), F.explode("fields").alias("out_col", "spec"))
    edge = out.select("job_ns", "job_name", "out_ns", "out_name", "out_col", F.explode_outer(F.try_variant_get("spec", "$.inputFields", _ROWS)).alias("f"))
    steps = F.coalesce(F.try_variant_get("f", "$.transformations", _ROWS), F.array().cast(_ROWS))
    direct = F.exists(steps, lambda t: F.coalesce(_text(t, "$.type") == "DIRECT", F.lit(False)))
    rank = F.when(F.col("f").isNull(), PRECISION_RANK["lost"]).when(direct, PRECISION_RANK["exact"]).otherwise(PRECISION_RANK["inferred"])
    keys = ["job_ns", "job_name", "out_ns", "out_name", "out_col", "in_ns", "in_name", "in_col"]
    edge = edge.select(*keys[:5], *[_text("f", f"$.{p}").alias(c) for p, c in (("namespace", "in_ns"), ("name", "in_name"), ("field", "in_col"))], rank.alias("rank"))
    return edge.groupBy(*keys).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n_claims")).select(*keys, _label(F.col("rank")).alias("precision"), "n_claims")


def facet_problems(lines: DataFrame, column: str = "value") -> DataFrame:
    """Per job: documents, malformed ones (their job is NULL), facets of another shape, and schema columns that no input field reaches."""
    given = F.try_variant_get("out", "$.facets.columnLineage", "variant")
    bad = given.isNotNull() & ~F.is_variant_null(given) & F.col("fields").isNull()
    inputs = lambda spec: F.coalesce(F.size(F.try_variant_get(spec, "$.inputFields", _ROWS)), F.lit(0))
    traced = F.coalesce(F.map_keys(F.map_filter("fields", lambda _, spec: inputs(spec) > 0)), F.array().cast("array<string>"))
    columns = F.transform(F.try_variant_get("out", "$.facets.schema.fields", _ROWS), lambda f: _text(f, "$.name"))
    untraced = F.coalesce(F.size(F.array_except(columns, traced)), F.lit(0))
    total = lambda c: F.sum(c.cast("long"))
    return _outputs(lines, column).groupBy("job_ns", "job_name").agg(
        F.count_if("first").alias("n_documents"), F.count_if("malformed").alias("n_malformed"), F.count_if(F.coalesce(bad, F.lit(False))).alias("n_bad_facets"), total(untraced).alias("n_untraced")
    )
