"""JSON payloads of any depth: what stands at which path, the resources and files that a tool names, level by level with VARIANT.

A pass opens the containers of several levels in the place of each row, without writing or
shuffling; only what is deeper is written for the next. It ends when no container is left, so
depth is not bounded and no document is walked in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.trace import _cut

#: Levels that are opened in one pass; what is deeper is written and opened in the next.
LEVELS = 20
#: Kinds of resources by the keys that name them (fixed values).
RESOURCE_KEYS = {
    "url": "url", "uri": "url", "endpoint": "url", "database": "database", "database_name": "database", "db": "database", "table": "table", "table_name": "table", "schema": "schema",
    "schema_name": "schema", "environment": "environment", "env": "environment", "server": "server", "server_name": "server", "host": "host", "hostname": "host", "project": "project", "project_id": "project",
}
#: Keys whose values are paths (fixed values).
PATH_KEYS = ("path", "file", "files", "filepath", "file_path", "targetfile", "target_file", "absolutepath")


def leaves(payloads: DataFrame, key: str = "event_id", payload: str = "payload") -> DataFrame:
    """(key, path, name, value, kind): each scalar of each JSON payload, with its path, the nearest key above it, its text and type.

    Elements of arrays have the key of their array. Text that is no JSON has no leaves; nor has an empty container. A JSON null is of kind void, its value null.
    """
    level = payloads.select(F.col(key), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.expr(f"try_parse_json(`{payload}`)").alias("v")).where("v IS NOT NULL")
    # a payload is no deeper than it has opening brackets: if these are few, nothing is left after the first pass
    brackets = F.length(payload) - F.length(F.translate(payload, "[{", ""))
    most = payloads.agg(F.coalesce(F.max(brackets), F.lit(0))).first()[0]
    out = None
    while True:
        for _ in range(min(most, LEVELS)):
            level = _opened(level, key)
        made = level.where(~_contains()).select(key, "path", "name", F.expr("try_variant_get(v, '$', 'string')").alias("value"), F.lower(F.schema_of_variant("v")).alias("kind"))
        out = made if out is None else out.unionByName(made)
        deeper = level.where(_contains())
        if most <= LEVELS or not deeper.limit(1).count():
            return out
        level = _cut(deeper)


def _contains() -> Column:
    """Whether v is an object or an array."""
    kind = F.schema_of_variant("v")
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def _opened(level: DataFrame, key: str) -> DataFrame:
    """level with what its containers hold in their place; scalars stay as they are, an empty container goes."""
    opened = F.col("pos").isNotNull()
    held = level.lateralJoin(_exploded(level.sparkSession)).where(opened | ~_contains())  # the kind of a container is found by reading all of it
    inner = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), "key"))
    return held.select(
        F.col(key), F.when(opened, inner).otherwise(F.col("path")).alias("path"), F.when(opened, F.coalesce("key", "name")).otherwise(F.col("name")).alias("name"), F.when(opened, F.col("value")).otherwise(F.col("v")).alias("v")
    )


def _exploded(spark):
    return spark.tvf.variant_explode_outer(F.col("v").outer())  # outer: of the row beside it


def _normal(kind: Column, value: Column) -> Column:
    """kind:value without white space around it; null for an empty one or one of several lines."""
    plain = F.trim(value)
    return F.when((plain != "") & ~plain.rlike(r"[\r\n\x00]"), F.concat_ws(":", kind, plain))


def resources(payloads: DataFrame, key: str = "event_id", payload: str = "payload") -> DataFrame:
    """(key, resource): the resources that a payload's tool names, at any depth of its input, and the tool itself; each once."""
    tool = F.coalesce(*[F.get_json_object(payload, p) for p in ("$.tool_name", "$.toolName", "$.toolCall.name")])
    name = F.when(tool.startswith("mcp__"), F.concat(F.lit("mcp:"), F.replace(F.substring(tool, 6, 1 << 30), F.lit("__"), F.lit("/")))).otherwise(F.concat(F.lit("tool:"), tool))
    own = payloads.select(key, name.alias("resource")).where("resource IS NOT NULL")
    kinds = F.create_map(*[F.lit(x) for kv in RESOURCE_KEYS.items() for x in kv])
    held = _inputs(payloads, key, payload)
    found = held.select(key, _normal(F.try_element_at(kinds, F.lower("name")), F.col("value")).alias("resource"), F.try_element_at(kinds, F.lower("name")).alias("_kind")).where("_kind IS NOT NULL AND resource IS NOT NULL")
    return own.unionByName(found.drop("_kind")).distinct()


def paths(payloads: DataFrame, key: str = "event_id", payload: str = "payload") -> DataFrame:
    """(key, path): the files that a payload's tool names at any depth of its input; each once."""
    held = _inputs(payloads, key, payload)
    return held.where(F.lower("name").isin(*PATH_KEYS)).select(key, F.col("value").alias("path")).distinct()


def _inputs(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """Texts below the tool's input."""
    given = F.coalesce(F.get_json_object(payload, "$.tool_input"), F.get_json_object(payload, "$.toolCall.args"))
    return leaves(payloads.select(key, given.alias("_given")).where("_given IS NOT NULL"), key, "_given").where("kind = 'string' AND name IS NOT NULL")
