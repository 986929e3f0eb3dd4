"""Lineage audits: column edges and precision, markers, identities, schema evolution,
timestamp precision, retention, reconciliation and declared-vs-observed datasets.

Every audit is a join/anti-join/aggregate over lineage tables; none collects rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import storage_to_logical
from .graph import bottleneck

# Precision order along a path (the weakest hop wins) and the markers a
# complete path needs.
PRECISION_RANK = {"exact": 0, "inferred": 1, "lost": 2}
# The kinds of hop.  An opaque decode is inferred whatever a run claims; orchestration moves no data.
HOPS = ("source->topic", "topic->job", "topic->job (opaque)", "job->sink", "orchestrator->job")
NO_DATA = "n/a"
REQUIRED_MARKERS = ("binlog", "kafka_offset", "snapshot_id")


def _rank(col: Column) -> Column:
    return F.coalesce(*[F.when(col == k, F.lit(v)) for k, v in PRECISION_RANK.items()], F.lit(1))


def _label(rank: Column) -> Column:
    return F.coalesce(*[F.when(rank == v, F.lit(k)) for k, v in PRECISION_RANK.items()])


# ------------------------------------------------------------ column lineage ---------


def resolve_merge_edges(observed: DataFrame) -> DataFrame:
    """Drop the MERGE self-edges (output attributed to the re-read target as IDENTITY);
    the mapping edges carry the real expression."""
    self_edge = (F.col("in_ns") == F.col("out_ns")) & (F.col("in_name") == F.col("out_name"))
    return observed.filter(~self_edge)


def hop_precision(hops: DataFrame, facets: DataFrame) -> DataFrame:
    """Precision per (run, hop): what its facet claims, ``inferred`` without a facet; at best ``inferred`` for an opaque hop, and
    ``n/a`` where no data moves."""
    claimed = _rank(F.coalesce(F.col("precision"), F.lit("inferred")))
    at_best = F.when(F.col("hop") == HOPS[2], PRECISION_RANK["inferred"]).otherwise(PRECISION_RANK["exact"])
    precision = F.when(F.col("hop") == HOPS[4], F.lit(NO_DATA)).otherwise(_label(F.greatest(claimed, at_best)))
    return hops.join(facets, ["run_id", "hop"], "left").select("run_id", "hop", precision.alias("precision"))


def path_precision(hop_prec: DataFrame) -> DataFrame:
    """Weakest hop along each run's path: exact only if every hop that moves data is exact."""
    return hop_prec.filter(F.col("precision") != NO_DATA).groupBy("run_id").agg(_label(F.max(_rank(F.col("precision")))).alias("precision"))


def untraced_columns(schema_cols: DataFrame, edges: DataFrame, reaching: DataFrame) -> DataFrame:
    """Sink columns of a run that do not trace to a source column: ``run_id, out_col, mark``.

    ``edges`` (with ``in_ns, in_name, in_col``) are the run's own; ``reaching`` are the upstream columns
    that reach a source column over any number of hops.  ``mark`` is ``inferred`` where the run has an edge that leads nowhere, ``lost``
    where it has none.
    """
    ends = reaching.select("in_ns", "in_name", "in_col").distinct().withColumn("_reaches", F.lit(1))
    per = edges.join(ends, ["in_ns", "in_name", "in_col"], "left").groupBy("run_id", "out_col").agg(F.max(F.coalesce("_reaches", F.lit(0))).alias("_r"))
    found = schema_cols.select("run_id", "out_col").join(per, ["run_id", "out_col"], "left").filter(F.coalesce("_r", F.lit(0)) == 0)
    return found.select("run_id", "out_col", F.when(F.col("_r").isNull(), F.lit("lost")).otherwise(F.lit("inferred")).alias("mark"))


def overclaimed_runs(claims: DataFrame, schema_cols: DataFrame, edges: DataFrame, reaching: DataFrame) -> DataFrame:
    """Runs that claim ``exact`` while their column-lineage facet misses table columns."""
    missing = untraced_columns(schema_cols, edges, reaching).groupBy("run_id").agg(F.count(F.lit(1)).alias("missing_columns"))
    return claims.filter(F.col("claimed_precision") == "exact").join(missing, "run_id").select("run_id", "missing_columns")


# ------------------------------------------------------------------ markers ----------


def missing_markers(run_ids: DataFrame, markers: DataFrame, required: Sequence[str] = REQUIRED_MARKERS) -> DataFrame:
    """``(run_id, marker_kind)`` for every required marker a run lacks."""
    need = run_ids.select("run_id", F.explode(F.array(*[F.lit(k) for k in required])).alias("marker_kind"))
    have = markers.select("run_id", "marker_kind").distinct()
    return need.join(have, ["run_id", "marker_kind"], "left_anti")


def complete_paths(run_ids: DataFrame, markers: DataFrame, events: DataFrame, required: Sequence[str] = REQUIRED_MARKERS) -> DataFrame:
    """Runs with every marker and a whole chain in one deployment ``(instance_id, stack_epoch)``.

    The chain is a source table, its topic among the run's inputs, and a dataset among its outputs; all
    events of the run must come from one deployment, which is where the chain is looked for.
    """
    gaps = missing_markers(run_ids, markers, required).select("run_id").distinct()
    from_source = F.exists("inputs", lambda i: i["name"].rlike(r"^[^.]+\.[^.]+\.[^.]+$"))  # a topic names its source table
    per = events.groupBy("run_id").agg(
        F.count_distinct("instance_id", "stack_epoch").alias("_d"),
        F.bool_or(F.coalesce(from_source, F.lit(False))).alias("_in"),
        F.bool_or(F.coalesce(F.size("outputs") > 0, F.lit(False))).alias("_out"),
    )
    whole = per.filter("_d = 1 AND _in AND _out").select("run_id")
    return run_ids.select("run_id").join(gaps, "run_id", "left_anti").join(whole, "run_id")


# --------------------------------------------------------------- identities ----------


def ambiguous_identities(datasets: DataFrame) -> DataFrame:
    """``(namespace, name)`` identities bound to more than one uuid."""
    return (
        datasets.groupBy("namespace_name", "name")
        .agg(F.count_distinct("uuid").alias("uuids"))
        .filter(F.col("uuids") > 1)
    )


def misattributed_edges(edge_ids: DataFrame, jobs: DataFrame, datasets: DataFrame, outlets: DataFrame) -> DataFrame:
    """OUTPUT edges into a namespace the job does not own, and jobs that read but never write.

    One join of the edges: per job, what it reads and writes and its foreign outputs come from one aggregate."""
    ds = datasets.select(F.col("uuid").alias("dataset_uuid"), F.col("namespace_name").alias("ds_ns"), F.concat_ws(":", "namespace_name", "name").alias("dataset"))
    jb = jobs.select(F.col("uuid").alias("job_uuid"), F.concat_ws(":", "namespace_name", "name").alias("job"))
    out = F.col("io_type") == "OUTPUT"
    e = edge_ids.join(ds, "dataset_uuid", "left").join(outlets, "job_uuid", "left")
    foreign = out & (F.col("ds_ns") != F.col("declared_namespace"))
    per_job = e.groupBy("job_uuid").agg(
        F.max((F.col("io_type") == "INPUT").cast("int")).alias("_in"), F.max(out.cast("int")).alias("_out"), F.collect_list(F.when(foreign, F.col("dataset"))).alias("_foreign")
    )
    found = F.concat(
        F.transform("_foreign", lambda d: F.struct(d.alias("dataset"), F.lit("foreign_output").alias("reason"))),
        F.when((F.col("_in") == 1) & (F.col("_out") == 0), F.array(F.struct(F.lit(None).cast("string").alias("dataset"), F.lit("input_without_output").alias("reason")))).otherwise(
            F.array().cast("array<struct<dataset:string,reason:string>>")
        ),
    )
    return per_job.select("job_uuid", F.explode(found).alias("f")).join(jb, "job_uuid").select("job", "f.dataset", "f.reason")


def jobs_without_io(jobs: DataFrame, edge_ids: DataFrame) -> DataFrame:
    """Jobs with no current dataset edge (orchestrator-style jobs)."""
    used = edge_ids.select("job_uuid").distinct()
    return jobs.join(used, jobs["uuid"] == used["job_uuid"], "left_anti").select(F.concat_ws(":", "namespace_name", "name").alias("job"))


def identity_collisions(connectors: DataFrame) -> DataFrame:
    """Emitter keys shared by several connectors (events get mis-attributed)."""
    return connectors.groupBy("emitter_key").agg(F.count_distinct("connector").alias("connectors")).filter(F.col("connectors") > 1)


def declared_vs_observed(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Orchestrator-declared inlets/outlets (URIs) vs the datasets a run really touched.

    Both sides are brought to one identity first: the whole path of the dataset as a URI, without a generated
    ``_<uuid>`` suffix, whatever part of it either side calls the namespace.
    """
    logical = lambda uri: storage_to_logical(F.regexp_replace(uri, "/+$", ""))
    d = declared.select("job_name", "io_type", logical(F.col("uri")).alias("uri"), F.lit(1).alias("_s"))
    o = observed.select("job_name", "io_type", logical(F.concat_ws("/", "namespace", "name")).alias("uri"), F.lit(2).alias("_s"))
    sides = d.unionByName(o).groupBy("job_name", "io_type", "uri").agg(F.bit_or("_s").alias("_s"))
    status = F.element_at(F.array(F.lit("declared_only"), F.lit("observed_only"), F.lit("both")), F.col("_s").cast("int"))
    return sides.select("job_name", "io_type", "uri", status.alias("status"))


# --------------------------------------------------------- schema evolution ----------

_FIELDS = "struct<fields:array<struct<name:string,type:string>>>"


def after_fields(registry_rows: DataFrame) -> DataFrame:
    """Fields of the ``after`` record of each writer schema (the table schema).

    The ``after`` field is a union with a named record; the record is defined inline in
    one of the envelope's fields (usually ``before``).  Resolution is a join on the
    record name within each schema id.
    """
    env = registry_rows.select("schema_id", "subject", "version", F.from_json("schema", _FIELDS).alias("s"))
    fields = env.select("schema_id", "subject", "version", F.explode("s.fields").alias("f")).select(
        "schema_id", "subject", "version", F.col("f.name").alias("env_field"), F.col("f.type").alias("t")
    )
    # a type is a union (array), a record (object) or the name of a record
    options = F.when(F.col("t").startswith("["), F.from_json("t", "array<string>")).otherwise(F.array("t"))
    branches = fields.select("schema_id", "subject", "version", "env_field", F.explode(options).alias("b")).filter(F.col("b") != "null")
    defs = branches.filter(F.col("b").startswith("{")).select(
        "schema_id", F.get_json_object("b", "$.name").alias("rec"), F.from_json("b", _FIELDS).alias("r")
    )
    after_ref = branches.filter(F.col("env_field") == "after").select(
        "schema_id", "subject", "version", F.when(F.col("b").startswith("{"), F.get_json_object("b", "$.name")).otherwise(F.col("b")).alias("rec")
    )
    rec = after_ref.join(defs, ["schema_id", "rec"]).dropDuplicates(["schema_id"])
    return rec.select("schema_id", "subject", "version", F.posexplode("r.fields").alias("field_pos", "f")).select(
        "schema_id",
        "subject",
        "version",
        "field_pos",
        F.col("f.name").alias("field_name"),
        F.col("f.type").alias("field_type"),
        (F.col("f.type").startswith("[") & F.col("f.type").contains('"null"')).alias("nullable"),
    )


def schema_changes(fields: DataFrame) -> DataFrame:
    """Field changes between a version of a subject and the next one there is (numbers may skip).

    ``added`` is allowed; ``removed`` and ``type_changed`` are breaking.
    """
    vers = fields.select("subject", "version").distinct()
    pairs = vers.select("subject", F.col("version").alias("from_version"), F.lead("version").over(Window.partitionBy("subject").orderBy("version")).alias("to_version"))
    pairs = pairs.filter(F.col("to_version").isNotNull())
    a = fields.select("subject", F.col("version").alias("from_version"), "field_name", F.col("field_type").alias("old_type"))
    b = fields.select("subject", F.col("version").alias("to_version"), "field_name", F.col("field_type").alias("new_type"))
    left = pairs.join(a, ["subject", "from_version"])
    right = pairs.join(b, ["subject", "to_version"])
    j = left.join(right, ["subject", "from_version", "to_version", "field_name"], "full_outer")
    change = (
        F.when(F.col("old_type").isNull(), F.lit("added"))
        .when(F.col("new_type").isNull(), F.lit("removed"))
        .when(F.col("old_type") != F.col("new_type"), F.lit("type_changed"))
    )
    return j.select("subject", "from_version", "to_version", "field_name", change.alias("change")).filter(F.col("change").isNotNull()).withColumn(
        "breaking", F.col("change") != "added"
    )


# --------------------------------------------------------------- reconcile -----------


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], a_name: str = "a", b_name: str = "b") -> DataFrame:
    """Rows that differ between two results of the same source (NULL-safe per column)."""
    vals = [c for c in a.columns if c not in keys]
    aa = a.select(*keys, F.struct(*vals).alias("_a"), F.lit(True).alias("_in_a"))
    bb = b.select(*keys, F.struct(*vals).alias("_b"), F.lit(True).alias("_in_b"))
    j = aa.join(bb, list(keys), "full_outer")
    diffs = F.concat_ws(",", *[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in vals])
    status = (
        F.when(F.col("_in_b").isNull(), F.lit(f"only_{a_name}"))
        .when(F.col("_in_a").isNull(), F.lit(f"only_{b_name}"))
        .when(diffs != "", F.lit("differs"))
    )
    return j.select(*keys, status.alias("status"), F.when(status == "differs", diffs).alias("diff_columns")).filter(F.col("status").isNotNull())


# ------------------------------------------------------------ time and retention -----


def ts_precision(source_rows: DataFrame) -> DataFrame:
    """Precision class counts of source timestamps; snapshot reads (``op='r'``) exempt."""
    return source_rows.filter(F.col("op") != "r").groupBy("precision").agg(F.count(F.lit(1)).alias("events"))


def commits_in_window(commits: DataFrame, windows: DataFrame) -> DataFrame:
    """Does each commit fall inside its run's observed window ``[w0, w1]``?

    Equi-join on ``run_id`` plus the range predicate -- never a nested loop.
    """
    j = commits.join(windows, "run_id", "left")
    inside = F.coalesce(F.col("committed_at").between(F.col("w0"), F.col("w1")), F.lit(False))
    return j.select("snapshot_id", "run_id", inside.alias("inside"))


def check_retention(
    snapshots: DataFrame,
    run_ranges: DataFrame,
    now: str,
    topic_retention: str = "168 hours",
    snapshot_retention: str = "7 days",
) -> DataFrame:
    """Retention invariant: every live snapshot must still be re-buildable from the topic.

    A snapshot is live while ``committed_at >= now - snapshot_retention``; it is
    replayable while the first message of its run is inside the topic retention.
    """
    now_c = F.lit(now).cast("timestamp_ntz")
    j = snapshots.join(run_ranges, "run_id", "left")
    live = F.col("committed_at") >= now_c - F.expr(f"INTERVAL {snapshot_retention}")
    replayable = F.coalesce(F.col("first_ts") >= now_c - F.expr(f"INTERVAL {topic_retention}"), F.lit(False))
    return j.select("table", "snapshot_id", "run_id", live.alias("live"), replayable.alias("replayable"), (live & ~replayable).alias("violation"))


# ------------------------------------------------------------ precision of paths -----


def column_path_precision(edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """Per sink column and column upstream of it, how precisely the best path between them is known: ``out_col, in_col, precision``.

    ``edges``: ``src, dst, precision`` of the column graph, ``sinks``: ``out_col``.  A path is as precise as its weakest hop, a hop without
    a precision is ``inferred``, and of several paths, or several claims for one hop, the most precise counts.
    """
    ranked = edges.select("src", "dst", _rank(F.col("precision")).alias("rank"))
    best = bottleneck(ranked, sinks.select(F.col("out_col").alias("root")), "up")
    return best.select(F.col("root").alias("out_col"), F.col("node").alias("in_col"), _label(F.col("rank")).alias("precision"))
