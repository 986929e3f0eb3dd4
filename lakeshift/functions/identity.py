"""Naming and identity rules as column expressions (JVM-side, no UDF).

Datasets, jobs and tables are joined across hops by *derived* names, so every rule here
is a pure ``Column -> Column`` function usable inside ``select``/``join`` conditions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Naming formats of the change-capture and lineage model.
MYSQL_NAMESPACE = "mysql://{host}:{port}"          # dataset name: {db}.{table}
KAFKA_NAMESPACE = "kafka://{bootstrap}"            # dataset name: the topic {prefix}.{db}.{table}
JSON_TOPIC_PREFIX = "mysqljson"                    # JSON twin of prefix "mysql"
SINK_LOGICAL = "{namespace}.{db}_{table}"          # JSON twin appends "_json"
SINK_PHYSICAL_NAMESPACE = "{catalog}.{namespace}"  # physical name: {db}_{table}
SINK_CATALOG = "nessie"
SINK_NAMESPACE = "poc"
CONNECTOR_JOB_LOGICAL = "debezium:{connector}"     # physical ns debezium.{connector}, name {prefix}.{task}
ORCHESTRATOR_JOB = "airflow:{dag_id}.{task_id}"
SPARK_JOB = "spark:{app_name}"
SUBJECT_SUFFIX_RE = r"-(value|key)$"
STORAGE_UUID_SUFFIX_RE = r"_[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
URI_SPLIT_RE = r"^(.*)/([^/]+)$"
MERMAID_ID_RE = r"[^A-Za-z0-9_]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def topic_prefix(topic) -> Column:
    return F.split_part(_c(topic), F.lit("."), F.lit(1))


def topic_db(topic) -> Column:
    return F.split_part(_c(topic), F.lit("."), F.lit(2))


def topic_table(topic) -> Column:
    return F.split_part(_c(topic), F.lit("."), F.lit(3))


def subject_to_topic(subject) -> Column:
    """Registry subject ``{topic}-value`` / ``{topic}-key`` -> topic."""
    return F.regexp_replace(_c(subject), SUBJECT_SUFFIX_RE, "")


def topic_to_subject(topic, kind: str = "value") -> Column:
    return F.concat(_c(topic), F.lit(f"-{kind}"))


def mysql_dataset_name(topic) -> Column:
    """Kafka topic -> MySQL dataset name ``{db}.{table}`` (the join key MySQL <-> Kafka)."""
    return F.concat_ws(".", topic_db(topic), topic_table(topic))


def sink_logical_name(namespace, topic) -> Column:
    """``{namespace}.{db}_{table}``, with ``_json`` appended for the JSON-prefix topics."""
    base = F.concat(_c(namespace), F.lit("."), topic_db(topic), F.lit("_"), topic_table(topic))
    return F.when(topic_prefix(topic) == F.lit(JSON_TOPIC_PREFIX), F.concat(base, F.lit("_json"))).otherwise(base)


def sink_physical_namespace() -> str:
    return SINK_PHYSICAL_NAMESPACE.format(catalog=SINK_CATALOG, namespace=SINK_NAMESPACE)


def uri_namespace(uri) -> Column:
    """Asset URI -> namespace (everything before the last ``/``)."""
    return F.regexp_extract(_c(uri), URI_SPLIT_RE, 1)


def uri_name(uri) -> Column:
    """Asset URI -> dataset name (after the last ``/``)."""
    return F.regexp_extract(_c(uri), URI_SPLIT_RE, 2)


def storage_to_logical(name) -> Column:
    """Strip the ``_<uuid>`` suffix a table-format writer appends to storage names."""
    return F.regexp_replace(_c(name), STORAGE_UUID_SUFFIX_RE, "")


def emitter_key(prefix, task) -> Column:
    """Per-connector event emitter key ``{prefix}:{task}``."""
    return F.format_string("%s:%s", _c(prefix), _c(task))


def connector_physical_namespace(connector) -> Column:
    return F.concat(F.lit("debezium."), _c(connector))


def connector_logical(connector) -> Column:
    return F.concat(F.lit("debezium:"), _c(connector))


def spark_job_logical(app) -> Column:
    return F.concat(F.lit("spark:"), _c(app))


def qualified(ns, name, sep: str = ":") -> Column:
    """``ns || ':' || name`` -- the graph node identity."""
    return F.concat_ws(sep, _c(ns), _c(name))


def tags_to_map(s) -> Column:
    """``k=v,k=v`` -> MAP<STRING,STRING>."""
    return F.str_to_map(_c(s), F.lit(","), F.lit("="))


def diagram_id(s) -> Column:
    """Identifier sanitising for diagram text: every char outside ``[A-Za-z0-9_]`` -> ``_``."""
    return F.regexp_replace(_c(s), MERMAID_ID_RE, "_")


def diagram_label(s) -> Column:
    """Escape ``|``, ``[`` and ``]`` for diagram labels, and drop double quotes."""
    out = F.replace(F.replace(_c(s), F.lit('"'), F.lit("")), F.lit("|"), F.lit("\\|"))
    out = F.replace(out, F.lit("["), F.lit("\\["))
    return F.replace(out, F.lit("]"), F.lit("\\]"))
