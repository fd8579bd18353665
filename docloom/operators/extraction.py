"""From a model's answers on chunks to the logs of entities and relations that the graph is reduced from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

from .graph import DEFAULT_PREDICATE, DEFAULT_TYPE

#: Items of an answer that count (fixed values).
ENTITIES, RELATIONS = 12, 18


def parsed(answers: DataFrame) -> DataFrame:
    """kb_id, chunk_id, entities, relations (arrays of variants), valid.

    answers: kb_id, chunk_id, answer (JSON text, also fenced or inside prose). An answer without an
    object is not valid and has no items; what is no list counts as an empty one.
    """
    v = F.try_parse_json(T.json_object(F.col("answer")))
    part = lambda name, most: F.slice(F.coalesce(F.try_variant_get("_v", f"$.{name}", "array<variant>"), F.array().cast("array<variant>")), 1, most)
    rows = answers.select("kb_id", "chunk_id", v.alias("_v"))
    return rows.select("kb_id", "chunk_id", part("entities", ENTITIES).alias("entities"), part("relationships", RELATIONS).alias("relations"), F.col("_v").isNotNull().alias("valid"))


def _field(name: str) -> Column:
    return F.try_variant_get("_x", f"$.{name}", "string")


def _shown(c: Column) -> Column:
    return F.substring(T.trim_space(F.regexp_replace(c, r"(?U)\s+", " ")), 1, T.CAPS["name"])


def entity_id(kb_id: Column, name: Column) -> Column:
    """The id of a base's entity: a hash of base and normalised name."""
    return F.substring(F.sha2(F.concat_ws("\x1f", kb_id, name), 256), 1, 32)


def logs(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity log, relation log) of all answers.

    Entities: kb_id, chunk_id, position, id, name, normalized_name, entity_type, description,
    mentioned. Relations: kb_id, chunk_id, position, source_id, target_id, predicate,
    description, weight. Items that are no objects, entities without a name and relations
    without an end, with a blank predicate or from a thing to itself are left out; a missing
    type, predicate or weight takes its default. An end that the answer doesn't declare is an
    entity of the default type after the declared ones that the chunk doesn't mention.
    """
    rows = parsed(answers)
    e = rows.select("kb_id", "chunk_id", F.posexplode("entities").alias("position", "_x"))
    e = e.select("kb_id", "chunk_id", "position", _shown(_field("name")).alias("name"), F.coalesce(_field("type"), F.lit(DEFAULT_TYPE)).alias("_t"), F.coalesce(_field("description"), F.lit("")).alias("_d"))
    e = e.withColumn("normalized_name", T.normalize_name(F.col("name"))).where(F.length("normalized_name") > 0)
    kind = F.substring(F.when(F.length("_t") > 0, F.col("_t")).otherwise(DEFAULT_TYPE), 1, T.CAPS["entity_type"])
    e = e.select("kb_id", "chunk_id", "position", "name", "normalized_name", kind.alias("entity_type"), F.substring("_d", 1, T.CAPS["description"]).alias("description"), F.lit(True).alias("mentioned"))

    r = rows.select("kb_id", "chunk_id", F.posexplode("relations").alias("position", "_x"))
    predicate = F.substring(T.trim_space(F.regexp_replace(F.coalesce(_field("predicate"), F.lit(DEFAULT_PREDICATE)), r"(?U)\s+", " ")), 1, T.CAPS["predicate"])
    r = r.select(
        "kb_id", "chunk_id", "position", _shown(_field("source")).alias("source"), _shown(_field("target")).alias("target"), predicate.alias("predicate"),
        F.substring(F.coalesce(_field("description"), F.lit("")), 1, T.CAPS["relation_description"]).alias("description"), T.clamp_weight(_field("weight").try_cast("double")).alias("weight"),
    )
    r = r.withColumns({"_s": T.normalize_name(F.col("source")), "_t": T.normalize_name(F.col("target"))})
    r = r.where("length(_s) > 0 and length(_t) > 0 and length(predicate) > 0 and _s <> _t")

    ends = r.select("kb_id", "chunk_id", F.posexplode(F.array(F.struct(F.col("source").alias("name"), F.col("_s").alias("n")), F.struct(F.col("target").alias("name"), F.col("_t").alias("n")))).alias("_i", "_e"), "position")
    ends = ends.select("kb_id", "chunk_id", (F.lit(ENTITIES) + 2 * F.col("position") + F.col("_i")).alias("position"), "_e.name", F.col("_e.n").alias("normalized_name"))
    ends = ends.groupBy("kb_id", "chunk_id", "normalized_name").agg(F.min(F.struct("position", "name")).alias("f")).select("kb_id", "chunk_id", "f.position", "f.name", "normalized_name")
    ends = ends.join(e.select("kb_id", "chunk_id", "normalized_name"), ["kb_id", "chunk_id", "normalized_name"], "left_anti")
    made = ends.select("kb_id", "chunk_id", "position", "name", "normalized_name", F.lit(DEFAULT_TYPE).alias("entity_type"), F.lit("").alias("description"), F.lit(False).alias("mentioned"))
    entities = e.unionByName(made).withColumn("id", entity_id(F.col("kb_id"), F.col("normalized_name")))
    relations = r.withColumns({"source_id": entity_id(F.col("kb_id"), F.col("_s")), "target_id": entity_id(F.col("kb_id"), F.col("_t"))}).drop("_s", "_t", "source", "target")
    return entities, relations
