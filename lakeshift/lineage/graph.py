"""Lineage graph: current edges from the lineage store, summaries, export, reachability.

Reachability is a frontier loop of equi-joins: each round joins the new frontier to the
edge table, removes already-visited (root, node) pairs with an anti-join, and cuts the
lineage with a reliable ``checkpoint()`` into the shared checkpoint folder, so a lost
executor recomputes at most one round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import diagram_id, diagram_label, qualified
from ..session import scratch_path, scratch_root


def current_edges(
    datasets: DataFrame, jobs: DataFrame, job_versions: DataFrame, io_mapping: DataFrame, order: bool = True, named: Callable[[str, str], Column] = qualified
) -> DataFrame:
    """``(job, dataset, io_type)`` for current job versions: io_mapping -> job_versions ->
    jobs, io_mapping -> datasets.  The filter runs before the joins; the planner sizes
    each join (broadcast when the runtime size allows, sort-merge otherwise).  Job versions
    meet their jobs first, so the mapping, the largest table, moves once less; ``named`` makes
    the names of namespace and name, once per job and dataset."""
    m = io_mapping.filter(F.col("is_current_job_version")).select("job_version_uuid", "dataset_uuid", "io_type")
    jv = job_versions.select(F.col("uuid").alias("job_version_uuid"), "job_uuid")
    j = jobs.select(F.col("uuid").alias("job_uuid"), named("namespace_name", "name").alias("job"))
    d = datasets.select(F.col("uuid").alias("dataset_uuid"), named("namespace_name", "name").alias("dataset"))
    e = m.join(jv.join(j, "job_uuid").select("job_version_uuid", "job"), "job_version_uuid").join(d, "dataset_uuid").select("job", "dataset", "io_type")
    return e.orderBy("io_type", "job") if order else e


def current_edge_ids(io_mapping: DataFrame, job_versions: DataFrame) -> DataFrame:
    """Current edges by uuid: ``(job_uuid, dataset_uuid, io_type)``."""
    m = io_mapping.filter(F.col("is_current_job_version")).select("job_version_uuid", "dataset_uuid", "io_type")
    jv = job_versions.select(F.col("uuid").alias("job_version_uuid"), "job_uuid")
    return m.join(jv, "job_version_uuid").select("job_uuid", "dataset_uuid", "io_type")


def count_by_namespace(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col("namespace_name").alias("namespace")).agg(F.count(F.lit(1)).alias(label)).orderBy("namespace")


def graph_summary(datasets: DataFrame, jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals: datasets, jobs, current edges (three global counts, one row each)."""
    def total(df: DataFrame, kind: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(kind).alias("kind"), "total")

    return total(datasets, "datasets").unionByName(total(jobs, "jobs")).unionByName(total(edges, "current_edges"))


#: Order of the lines of one group.
_WITHIN = {"header": 0, "group": 1, "dataset": 2, "job": 2, "end": 3, "edge": 4}


def diagram_node(namespace: str, name: str) -> Column:
    """Identifier of a node, as ``export_edges`` makes it of the qualified name."""
    return diagram_id(qualified(namespace, name))


def export_edges(datasets: DataFrame, jobs: DataFrame, edges_by_name: DataFrame, identified: bool = False) -> DataFrame:
    """Diagram text as ``(section, grp, line)`` rows, written by Spark (``df.write.text``).

    A header; per namespace of datasets (``DS_``) and of jobs (``JB_``) a group with its nodes and its ``end``; one line per
    edge: INPUT is ``dataset --> job``, OUTPUT is ``job --> dataset``.  Identifiers are sanitised, labels escaped and rid of quotes, with
    column expressions; nothing is collected to the driver.  ``identified``: the ends of the edges are identifiers (``diagram_node``) already.
    """
    parts = []
    for kind, rows, prefix, node, title in (("dataset", datasets, "DS_", "D_", ""), ("job", jobs, "JB_", "J_", "jobs: ")):
        group = F.concat(F.lit(prefix), diagram_id(F.col("namespace_name")))
        names = rows.select("namespace_name").distinct()
        parts.append(names.select(F.lit("group").alias("section"), group.alias("grp"), F.concat(F.lit("subgraph "), group, F.lit(f'["{title}'), diagram_label(F.col("namespace_name")), F.lit('"]')).alias("line")))
        parts.append(rows.select(F.lit(kind).alias("section"), group.alias("grp"), F.concat(F.lit(node), diagram_id(F.concat_ws("/", "namespace_name", "name")), F.lit('["'), diagram_label(F.col("name")), F.lit('"]')).alias("line")))
        parts.append(names.select(F.lit("end").alias("section"), group.alias("grp"), F.lit("end").alias("line")))
    of = F.col if identified else diagram_id
    jid, did = F.concat(F.lit("J_"), of("job")), F.concat(F.lit("D_"), of("dataset"))
    arrow = F.when(F.col("io_type") == "INPUT", F.concat(did, F.lit(" -->|INPUT| "), jid)).otherwise(F.concat(jid, F.lit(" -->|OUTPUT| "), did))
    parts.append(edges_by_name.select(F.lit("edge").alias("section"), F.lit("").alias("grp"), arrow.alias("line")))
    parts.append(datasets.sparkSession.range(1).select(F.lit("header").alias("section"), F.lit("").alias("grp"), F.lit("graph LR").alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_diagram(lines: DataFrame, path: str) -> None:
    """Write ``export_edges`` output as text: the header, each group with its nodes and its end, then the edges.

    A distributed sort (range partitioning) writes ordered part files; concatenated in
    part order they are the diagram.  No single task sees all lines.
    """
    within = F.element_at(F.create_map(*[F.lit(x) for kv in _WITHIN.items() for x in kv]), F.col("section"))
    part = F.when(F.col("section") == "header", 0).when(F.col("section") == "edge", 2).otherwise(1)
    lines.select(part.alias("_p"), "grp", within.alias("_w"), "line").orderBy("_p", "grp", "_w", "line").select("line").write.mode("overwrite").text(path)


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "down") -> DataFrame:
    """Transitive closure from seed nodes: ``(root, node, depth)`` for depth >= 1.

    ``edges``: ``(src, dst)``; ``seeds``: ``(root)``.  ``direction="up"`` follows edges
    backwards (ancestors).  Goes on until a round adds nothing, however deep (cycles are cut by
    the visited anti-join).  The edges are dealt out by their start once, so a round shuffles only its frontier.
    """
    scratch_root(edges.sparkSession)
    e = edges.select(F.col("src").alias("_from"), F.col("dst").alias("_to")) if direction == "down" else edges.select(
        F.col("dst").alias("_from"), F.col("src").alias("_to")
    )
    # the edge table is read once per round: keep it for the loop (lost blocks are
    # recomputed from lineage); the result only depends on the checkpointed rounds
    e = e.repartition("_from").persist(StorageLevel.MEMORY_AND_DISK)
    frontier = seeds.select("root", F.col("root").alias("node")).distinct()
    visited = None  # a root is in its own closure only when a cycle leads back to it
    parts: list[DataFrame] = []
    for depth in count(1):
        nxt = (
            frontier.join(e, frontier["node"] == e["_from"])
            .select("root", F.col("_to").alias("node"))
            .distinct()
        )
        if visited is not None:
            nxt = nxt.join(visited.select("root", "node"), ["root", "node"], "left_anti")
        nxt = nxt.withColumn("depth", F.lit(depth)).checkpoint()
        if nxt.isEmpty():
            break
        parts.append(nxt)
        visited = nxt if visited is None else visited.unionByName(nxt)  # union of materialised pieces
        frontier = nxt.select("root", "node")
    e.unpersist()
    if not parts:
        return frontier.withColumn("depth", F.lit(0)).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bottleneck(edges: DataFrame, seeds: DataFrame, direction: str = "down") -> DataFrame:
    """Best path by its weakest edge: ``(root, node, rank)``, the least over all paths of the greatest ``rank`` along the path.

    ``edges``: ``(src, dst, rank)``; ``seeds``: ``(root)``.  A round relaxes the pairs that the round before improved, so it ends for any
    cycles, after at most as many rounds as the longest simple path has edges.  Pairs keep one partitioning by ``(root, node)`` and edges one by
    their start, in a number of partitions that stays as it is, so a round moves its frontier and what it finds; one that finds nothing writes no pairs.
    """
    spark = edges.sparkSession
    scratch_root(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = ("src", "dst") if direction == "down" else ("dst", "src")
    e = edges.select(F.col(ends[0]).alias("_from"), F.col(ends[1]).alias("node"), "rank").filter("_from is not null")
    e = e.repartition(n, "_from").groupBy("_from", "node").agg(F.min("rank").alias("_rank")).sortWithinPartitions("_from").checkpoint()
    frontier = seeds.select("root", F.col("root").alias("_from"), F.lit(None).cast("int").alias("rank")).distinct()
    best = None
    while True:
        met = frontier.join(e, "_from").select("root", "node", F.greatest("rank", "_rank").cast("int").alias("rank"))
        found = met.repartition(n, "root", "node").groupBy("root", "node").agg(F.min("rank").alias("rank")).checkpoint()
        if found.isEmpty():
            return found if best is None else best
        if best is None:
            fresh = best = found
        else:
            old = best.select("root", "node", F.col("rank").alias("_old"))
            better = F.coalesce(F.col("rank") < F.col("_old"), F.col("_old").isNull())
            state = old.join(found, ["root", "node"], "full_outer").select("root", "node", F.least("_old", "rank").alias("rank"), better.alias("_new")).checkpoint()
            fresh, best = state.filter("_new"), state.select("root", "node", "rank")
            if fresh.isEmpty():
                return best
        frontier = fresh.select("root", F.col("node").alias("_from"), "rank")


def _written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, and with it constraints that a loop of joins would pile up."""
    path = scratch_path(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _greatest_source(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, colour``: the greatest node that reaches it, itself included.

    Colours run along the edges.  What reaches a node's colour reaches the node, so a round also takes over its colour's own colour,
    which saves rounds.
    """
    now = _written(nodes.select("node", F.col("node").alias("colour")))
    while True:
        sent = edges.join(now, edges["src"] == now["node"]).select(F.col("dst").alias("node"), "colour", F.lit(None).cast("string").alias("old"))
        met = now.withColumn("old", F.col("colour")).unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour"), F.max("old").alias("old"))
        over = now.select(F.col("node").alias("colour"), F.col("colour").alias("further"))
        met = _written(met.join(over, "colour").select("node", F.greatest("colour", "further").alias("colour"), "old"))
        now = met.select("node", "colour")
        if met.filter("colour <> old").isEmpty():
            return now


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node that lies on a cycle (a node with an edge to itself too); the component is its least node.

    ``edges``: ``(src, dst)`` strings; edges with a NULL end are ignored.  Forward-backward colouring by equi-joins: the greatest node that
    reaches a node colours it, the greatest node that it reaches along edges of its colour answers; where both agree, it is in that node's component.
    A component has one colour and one answer, so edges between colours or between answers go, as do finished nodes and ends without a
    way in or out, until no edge is left.
    """
    edges = _written(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left, found = edges.filter("src <> dst"), []
    while True:
        ends = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = _written(left.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select("src", "dst"))
        if left.isEmpty():
            break
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        forward = _greatest_source(nodes, left)
        inside = _written(_within(left, forward, "colour"))
        back = _greatest_source(nodes, inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("colour", "answer")
        both = _written(forward.join(back, "node"))
        found.append(both.filter("colour = answer").select("node", F.col("colour").alias("root")))
        left = _within(inside, both.filter("colour <> answer"), "answer")
    if not found:
        return loops
    rows = reduce(DataFrame.unionByName, found)  # materialised pieces
    named = rows.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    cycles = rows.join(named, "root").select("node", "component")
    return cycles.unionByName(loops.join(cycles, "node", "left_anti"))


def _within(edges: DataFrame, marks: DataFrame, mark: str) -> DataFrame:
    """Edges both of whose ends are in ``marks``, with the same ``mark``."""
    one, two = (marks.select(F.col("node").alias(end), F.col(mark).alias(f"_{end}")) for end in ("src", "dst"))
    return edges.join(one, "src").join(two, "dst").filter("_src = _dst").select("src", "dst")


def end_to_end_paths(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Chained equi-joins along a fixed hop sequence of node kinds (``kind:id`` nodes).

    ``kinds = ["region", "nation", "customer", "order"]`` yields one row per complete
    path with one column per kind and the ``path`` string.
    """
    hops = []
    for a, b in zip(kinds, kinds[1:]):
        hops.append(
            edges.filter(F.col("src").startswith(a + ":") & F.col("dst").startswith(b + ":")).select(F.col("src").alias(a), F.col("dst").alias(b))
        )
    path = hops[-1]
    for h, k in zip(reversed(hops[:-1]), reversed(kinds[1:-1])):
        path = path.join(h, k)
    return path.select(*kinds, F.concat_ws(">", *kinds).alias("path"))


def diff_edges(expected: DataFrame, actual: DataFrame, present: bool = False) -> DataFrame:
    """Design-vs-actual comparison on edge identity: ``expected_only`` / ``actual_only``, and with
    ``present`` also the edges of both sides."""
    both = expected.select("src", "dst", F.lit(1).alias("_s")).unionByName(actual.select("src", "dst", F.lit(2).alias("_s")))
    sides = both.groupBy("src", "dst").agg(F.bit_or("_s").alias("_s"))
    status = F.element_at(F.array(F.lit("expected_only"), F.lit("actual_only"), F.lit("present")), F.col("_s").cast("int"))
    out = sides.select("src", "dst", status.alias("status"))
    return out if present else out.filter(F.col("status") != "present")
