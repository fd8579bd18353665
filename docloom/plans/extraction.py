"""Queries over a model's answers.

No table holds answers, so Spark writes them from what the tables say of each chunk: plainly,
in a fence or inside prose, and broken for some chunks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import extraction as X
from docloom.tables import read

from .base import TRIM, W, query


def answers(spark, sf_dir):
    """kb_id, chunk_id, answer: the entities of a chunk by id and the relations it is evidence for by id, as a model would write them."""
    e, m, r = (read(spark, sf_dir, n) for n in ("entities", "entity_chunks", "relationships"))
    told = m.select("entity_id", "chunk_id").distinct().join(e.select(F.col("id").alias("entity_id"), "kb_id", "name", F.col("entity_type").alias("type"), "description"), "entity_id")
    item = F.struct("entity_id", F.struct("name", "type", "description").alias("x"))
    told = told.groupBy("kb_id", "chunk_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["x"]).alias("entities"))
    names = e.select("id", "name")
    r = r.where("evidence_chunk_id is not null").dropDuplicates(["id"]).join(names.withColumnsRenamed({"id": "source_id", "name": "source"}), "source_id").join(names.withColumnsRenamed({"id": "target_id", "name": "target"}), "target_id")
    item = F.struct("id", F.struct("source", "target", "predicate", "weight").alias("x"))
    r = r.groupBy(F.col("kb_id").alias("_kb"), F.col("evidence_chunk_id").alias("_chunk")).agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["x"]).alias("relationships"))
    rows = told.join(r, (F.col("kb_id") == F.col("_kb")) & (F.col("chunk_id") == F.col("_chunk")), "full").withColumns({"kb_id": F.coalesce("kb_id", "_kb"), "chunk_id": F.coalesce("chunk_id", "_chunk")})
    text, way = F.to_json(F.struct("entities", "relationships")), F.substring("chunk_id", -1, 1)
    text = F.when(way.isin("0", "1"), F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(way == "2", F.concat(F.lit("Here it is: "), text, F.lit(" That is all."))).when(way == "3", F.lit("no object")).otherwise(text)
    return rows.select("kb_id", "chunk_id", text.alias("answer"))


_SHOWN = lambda c: f"substr(regexp_replace(regexp_replace({c}, '{W}+', ' ', 'g'), {TRIM}), 1, 160)"
_LOGS = f"""with decl as (select kb_id, chunk_id, r - 1 as position, {_SHOWN('name')} as name, substr(coalesce(nullif(entity_type, ''), '概念'), 1, 40) as entity_type, substr(coalesce(description, ''), 1, 600) as description from (
select x.chunk_id, e.*, row_number() over (partition by e.kb_id, x.chunk_id order by e.id) as r from (select distinct entity_id, chunk_id from entity_chunks) x join entities e on e.id = x.entity_id)
where r <= 12 and right(chunk_id, 1) <> '3'), d as (select * from decl where length(name) > 0),
rel as (select kb_id, chunk_id, r - 1 as position, {_SHOWN('source')} as source, {_SHOWN('target')} as target, substr(regexp_replace(regexp_replace(coalesce(predicate, '相关'), '{W}+', ' ', 'g'), {TRIM}), 1, 100) as predicate,
case when weight is null then 1.0 when weight::varchar = 'nan' then 0.1 else least(10.0, greatest(0.1, weight)) end as weight from (
select r.kb_id, r.evidence_chunk_id as chunk_id, s.name as source, t.name as target, predicate, weight, row_number() over (partition by r.kb_id, r.evidence_chunk_id order by r.id) as r
from (select distinct on (id) * from relationships where evidence_chunk_id is not null) r join entities s on s.id = source_id join entities t on t.id = target_id) where r <= 18 and right(chunk_id, 1) <> '3'),
rl as (select * from rel where length(source) > 0 and length(target) > 0 and length(predicate) > 0 and lower(source) <> lower(target)),
ends as (select kb_id, chunk_id, 12 + 2 * position as position, source as name from rl union all select kb_id, chunk_id, 13 + 2 * position, target from rl),
made as (select kb_id, chunk_id, min(position) as position, arg_min(name, position) as name from ends z where not exists (select 1 from d where d.kb_id = z.kb_id and d.chunk_id = z.chunk_id and lower(d.name) = lower(z.name)) group by kb_id, chunk_id, lower(z.name))
"""


@query(_LOGS + "select kb_id, chunk_id, position, name, entity_type, md5(description) as description, true as mentioned from d union all select kb_id, chunk_id, position, name, '概念', md5(''), false from made")
def extraction_entities(spark, sf_dir):
    """The entity log of all answers, ends of relations included."""
    rows = X.logs(answers(spark, sf_dir))[0]
    return rows.select("kb_id", "chunk_id", F.col("position").cast("long").alias("position"), "name", "entity_type", F.md5("description").alias("description"), "mentioned")


@query(_LOGS + "select kb_id, chunk_id, name from made")
def created_endpoints(spark, sf_dir):
    """Entities that only a relation names."""
    return X.logs(answers(spark, sf_dir))[0].where("not mentioned").select("kb_id", "chunk_id", "name")


@query(_LOGS + "select kb_id, chunk_id, position, lower(source) as source, lower(target) as target, predicate, weight from rl")
def extraction_relations(spark, sf_dir):
    """The relation log of all answers, the ends as the names that their ids stand for."""
    e, r = X.logs(answers(spark, sf_dir))
    e = e.select("id", "normalized_name").distinct()
    r = r.join(e.withColumnsRenamed({"id": "source_id", "normalized_name": "source"}), "source_id").join(e.withColumnsRenamed({"id": "target_id", "normalized_name": "target"}), "target_id")
    return r.select("kb_id", "chunk_id", F.col("position").cast("long").alias("position"), "source", "target", "predicate", "weight")
