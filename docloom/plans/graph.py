"""Queries over the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions.embedding import embed, hashed_words
from docloom.operators import alias
from docloom.operators import graph as G
from docloom.operators.components import components
from docloom.operators.ranking import numbered
from docloom.tables import Stage, read

from .base import TRIM, W, query, stamp

_NAME = f"lower(regexp_replace(regexp_replace(name, '{W}+', ' ', 'g'), {TRIM}))"
_REL = """rel as (select id, kb_id, source_id, target_id, coalesce(nullif(trim(predicate), ''), '相关') as predicate, coalesce(description, '') as description, evidence_chunk_id, created_at,
case when weight is null then 1.0 when weight::varchar = 'nan' then 0.1 else least(10.0, greatest(0.1, weight)) end as weight
from relationships where source_id is not null and target_id is not null and source_id <> target_id)"""


def _up(rel: str = "rel") -> str:
    return f"""(select kb_id, source_id, target_id, predicate, arg_min(id, (created_at, id)) as id, max(weight) as weight, arg_min(description, (-length(description), created_at, id)) as description,
arg_min(struct_pack(e := evidence_chunk_id), (created_at, id)).e as evidence_chunk_id, count(*) as rows from {rel} group by 1, 2, 3, 4)"""


_MENT = "ment as (select entity_id, chunk_id, max(mention_count) as mention_count from entity_chunks group by 1, 2)"
_EM = _MENT + """, em as (select e.*, coalesce(source_chunks, 0) as source_chunks, coalesce(m, 0)::bigint as mentions from entities e
left join (select entity_id, count(*) as source_chunks, sum(mention_count) as m from ment group by 1) x on x.entity_id = e.id)"""
_GROUPS = """ yes as (select left_id a, right_id b, canonical from matches where same_entity and left_id <> right_id),
ed as (select a, b from yes union select b, a from yes), reach(a, b) as (select a, a from ed union select r.a, ed.b from reach r join ed on ed.a = r.b),
comp as (select a as node, min(b) as component from reach group by 1),
vote as (select n as node, count(*) votes from (select case canonical when 'left' then a when 'right' then b end n from yes) where n is not null group by 1),
pick as (select component, arg_max(node, (coalesce(votes, 0), mentions, length(coalesce(description, '')), -length(coalesce(name, '')), node)) as canonical_id, count(*) n
from comp join em on em.id = comp.node left join vote using (node) group by 1),
al as (select node as entity_id, canonical_id from comp join em on em.id = comp.node join pick using (component) where n > 1)"""


def _t(spark, sf_dir, *names):
    return [read(spark, sf_dir, n) for n in names]


@query(f"""select kb_id, normalized_name, arg_min(id, (created_at, id)) as id, arg_min(name, (created_at, id)) as name,
coalesce(arg_min(case when t <> '概念' then t end, case when t <> '概念' then (created_at, id) end), '概念') as entity_type,
arg_min(d, (-length(d), created_at, id)) as description, count(*) as rows
from (select *, {_NAME} as nn, coalesce(entity_type, '概念') t, coalesce(description, '') d from entities) s(id, kb_id, name, old_name, et, de, created_at, normalized_name, t, d)
where length(normalized_name) > 0 group by 1, 2""")
def entity_upsert(spark, sf_dir):
    """Entities reduced by name."""
    return G.entity_upsert(read(spark, sf_dir, "entities"))


@query(f"with {_REL} select kb_id, source_id, target_id, predicate, id, weight, description, evidence_chunk_id, rows from {_up()}")
def relation_upsert(spark, sf_dir):
    """Relations reduced by their ends and predicate."""
    return G.relation_upsert(read(spark, sf_dir, "relationships"))


@query(f"with {_MENT} select entity_id, chunk_id, mention_count from ment")
def mention_counts(spark, sf_dir):
    """Mentions, replays counted once."""
    return G.mentions(read(spark, sf_dir, "entity_chunks"))


@query(f"with {_EM} select kb_id, id, name, entity_type, source_chunks, mentions as mention_count from em")
def entities_export(spark, sf_dir):
    """Entities with their mentions."""
    e, x = _t(spark, sf_dir, "entities", "entity_chunks")
    return G.entity_mentions(e, x).select("kb_id", "id", "name", "entity_type", "source_chunks", "mention_count")


@query("""select r.kb_id, r.id, s.name as source, t.name as target, r.predicate, c.chunk_index as evidence_chunk_index, d.filename as evidence_file
from (select distinct kb_id, id, source_id, target_id, predicate, evidence_chunk_id from relationships) r join entities s on s.id = r.source_id join entities t on t.id = r.target_id
left join chunks c on c.id = r.evidence_chunk_id left join documents d on d.doc_id = c.document_id""")
def relationships_export(spark, sf_dir):
    """Relations with names and the place of their evidence."""
    r, e, c, d = _t(spark, sf_dir, "relationships", "entities", "chunks", "documents")
    r = r.select("kb_id", "id", "source_id", "target_id", "predicate", "evidence_chunk_id").distinct()
    r = r.join(e.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(e.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id")
    place = c.select(F.col("id").alias("evidence_chunk_id"), F.col("chunk_index").alias("evidence_chunk_index"), "document_id")
    r = r.join(place, "evidence_chunk_id", "left").join(d.select(F.col("doc_id").alias("document_id"), F.col("filename").alias("evidence_file")), "document_id", "left")
    return r.select("kb_id", "id", "source", "target", "predicate", "evidence_chunk_index", "evidence_file")


@query("""select distinct kb_id, entity_id from (select kb_id, source_id as entity_id from relationships union all select kb_id, target_id from relationships) where entity_id is not null and entity_id not in (select id from entities)""")
def missing_endpoints(spark, sf_dir):
    """Ends of relations without an entity."""
    return G.missing_endpoints(*_t(spark, sf_dir, "relationships", "entities"))


@query()
def match_quality(spark, sf_dir):
    """J9 over the asked pairs: likeness of names and types (difflib has no SQL twin)."""
    return G.match_quality(*_t(spark, sf_dir, "matches", "entities"))


@query()
def alias_candidates(spark, sf_dir):
    """Names of a base so like that a judge is to be asked, by the classes of `alias_classes` (tested against all pairs)."""
    return alias.candidates(read(spark, sf_dir, "entities"))


@query(f"""select kb_id, nn as normalized_name, coalesce(entity_type, '') as entity_type, min(id) as class_id, count(distinct id) as entities from (select *, {_NAME} as nn from entities) where length(nn) > 0 and kb_id is not null group by 1, 2, 3""")
def alias_classes(spark, sf_dir):
    """Entities of a base with one name and type, which stand in the candidates as one."""
    return alias.name_classes(read(spark, sf_dir, "entities"))


@query("""select least(left_id, right_id) as a, greatest(left_id, right_id) as b, arg_max(same_entity, (judged_at, pair_id)) as verdict, count(*) as answers, count_if(same_entity) as yes
from matches where left_id is not null and right_id is not null and left_id <> right_id and same_entity is not null group by 1, 2""")
def latest_verdicts(spark, sf_dir):
    """Answers to one pair, whichever way it was asked: the last one and how many said yes."""
    m = read(spark, sf_dir, "matches").where("left_id is not null and right_id is not null and left_id <> right_id and same_entity is not null")
    g = m.groupBy(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b"))
    return g.agg(F.max_by("same_entity", F.struct("judged_at", "pair_id")).alias("verdict"), F.count(F.lit(1)).alias("answers"), F.count_if("same_entity").alias("yes"))


@query(f"with recursive {_EM},{_GROUPS} select entity_id, canonical_id from al")
def alias_map(spark, sf_dir):
    """Each matched entity's canonical one."""
    return G.alias_map(*_t(spark, sf_dir, "matches", "entities", "entity_chunks"))


@query(f"""with recursive {_EM},{_GROUPS}, {_REL}, mr as (select rel.* exclude (source_id, target_id), coalesce(x.canonical_id, source_id) as source_id, coalesce(y.canonical_id, target_id) as target_id
from rel left join al x on x.entity_id = source_id left join al y on y.entity_id = target_id), mm as (select * from mr where source_id <> target_id)
select kb_id, source_id, target_id, predicate, id, weight, rows from {_up("mm")}""")
def merged_relations(spark, sf_dir):
    """A10: relations after the merge of aliases."""
    m, e, x, r = _t(spark, sf_dir, "matches", "entities", "entity_chunks", "relationships")
    return G.merge_relations(r, G.alias_map(m, e, x)).select("kb_id", "source_id", "target_id", "predicate", "id", "weight", "rows")


@query(f"with recursive {_EM},{_GROUPS} select coalesce(canonical_id, entity_id) as entity_id, chunk_id, sum(mention_count)::bigint as mention_count from ment left join al using (entity_id) group by 1, 2")
def merged_mentions(spark, sf_dir):
    """A10: mentions after the merge of aliases."""
    m, e, x = _t(spark, sf_dir, "matches", "entities", "entity_chunks")
    return G.merge_mentions(x, G.alias_map(m, e, x))


_ADJ = _REL + ", adj as (select kb_id, a as node, b as neighbour, sum(weight) as weight from (select kb_id, source_id a, target_id b, weight from rel union all select kb_id, target_id, source_id, weight from rel) group by 1, 2, 3)"


@query(f"with {_ADJ} select kb_id, node, neighbour, round(weight, 4) as weight from adj")
def adjacency(spark, sf_dir):
    """Undirected weights."""
    return G.adjacency(read(spark, sf_dir, "relationships")).withColumn("weight", F.round("weight", 4))


@query("select kb_id, entity_id, count(*) as degree from (select kb_id, source_id as entity_id from relationships union all select kb_id, target_id from relationships) where entity_id is not null group by 1, 2")
def degrees(spark, sf_dir):
    """Ends of relations per entity."""
    return G.degrees(read(spark, sf_dir, "relationships"))


_PAGE = f"""{_EM}, {_REL}, nodes as (select * from (select kb_id, id, name, entity_type, mentions, row_number() over (partition by kb_id order by mentions desc, name nulls first, id) as rank from em) where rank <= 100),
edges as (select u.* from {_up()} u where source_id in (select id from nodes) and target_id in (select id from nodes))"""


def _page(spark, sf_dir):
    return G.page(*_t(spark, sf_dir, "entities", "entity_chunks", "relationships"), limit=100)


@query(f"with {_PAGE} select kb_id, id, name, entity_type, mentions as mention_count, rank from nodes")
def graph_page_nodes(spark, sf_dir):
    """Each base's most mentioned entities."""
    return _page(spark, sf_dir)[0].withColumn("rank", F.col("rank").cast("long"))


@query(f"with {_PAGE} select kb_id, source_id, target_id, predicate, id, weight from edges")
def graph_page_edges(spark, sf_dir):
    """Relations with both ends on the page."""
    return _page(spark, sf_dir)[1].select("kb_id", "source_id", "target_id", "predicate", "id", "weight")


@query(f"""with recursive {_PAGE}, ed as (select source_id a, target_id b from rel union select target_id, source_id from rel), reach(a, b) as (select a, a from ed union select r.a, ed.b from reach r join ed on ed.a = r.b),
comp as (select a as node, min(b) as community from reach group by 1), c as (select kb_id, count(distinct community) as communities from comp join entities e on e.id = node group by 1),
n as (select kb_id, count(*) as entities from entities group by 1), r as (select kb_id, count(*) as relations from {_up()} group by 1), x as (select kb_id, count(*) as shown from edges group by 1)
select n.kb_id, entities, least(entities, 100) as entities_shown, coalesce(relations, 0) as relations, coalesce(shown, 0) as relations_shown, coalesce(communities, 0) as communities, least(100, coalesce(communities, 0)) as communities_shown,
entities > 100 or coalesce(relations, 0) > coalesce(shown, 0) or coalesce(communities, 0) > 100 as truncated from n left join r using (kb_id) left join x using (kb_id) left join c using (kb_id)""")
def truncation_flags(spark, sf_dir):
    """Whether a page of 100 entities, the relations among them and 100 communities (here connected components) shows less than there is."""
    e, r = _t(spark, sf_dir, "entities", "relationships")
    count = lambda df, name: df.groupBy("kb_id").agg(F.count(F.lit(1)).alias(name))
    found = components(G.clean_relations(r), "source_id", "target_id").withColumnRenamed("node", "id").join(e.select("id", "kb_id"), "id").select("kb_id", "component").distinct()
    rows = count(e, "entities")
    for df, name in ((G.relation_upsert(r), "relations"), (_page(spark, sf_dir)[1], "relations_shown"), (found, "communities")):
        rows = rows.join(count(df, name), "kb_id", "left")
    rows = rows.fillna(0, ["relations", "relations_shown", "communities"])
    rows = rows.withColumns({"entities_shown": F.least("entities", F.lit(100)), "communities_shown": F.least("communities", F.lit(100))})
    cut = (F.col("entities") > F.col("entities_shown")) | (F.col("relations") > F.col("relations_shown")) | (F.col("communities") > F.col("communities_shown"))
    return rows.select("kb_id", "entities", "entities_shown", "relations", "relations_shown", "communities", "communities_shown", cut.alias("truncated"))


@query(f"""with {_PAGE}, deg as (select id, count(*) d from (select source_id id from edges union all select target_id from edges) group by 1),
s as (select kb_id, id, name, 4 * coalesce(d, 0) + mentions as score, count(*) over (partition by kb_id) n from nodes left join deg using (id)),
r as (select *, row_number() over (partition by kb_id order by score desc, name nulls first, id) as label_rank from s)
select kb_id, id, name, score, label_rank from r where label_rank <= least(24, greatest(10, ceil(3 * sqrt(n))))""")
def important_labels(spark, sf_dir):
    """The nodes whose names are shown."""
    nodes, edges = _page(spark, sf_dir)
    return G.important(nodes, edges).withColumn("label_rank", F.col("label_rank").cast("long"))


@query(f"""with {_REL}, u as (select * from {_up()}) select kb_id, id, row_number() over (partition by kb_id, least(source_id, target_id), greatest(source_id, target_id) order by predicate, id) as parallel_rank,
count(*) over (partition by kb_id, least(source_id, target_id), greatest(source_id, target_id)) as parallel_count from u""")
def parallel_edges(spark, sf_dir):
    """Several relations of one pair."""
    return G.parallel_edges(read(spark, sf_dir, "relationships")).withColumn("parallel_rank", F.col("parallel_rank").cast("long"))


@query(f"""with {_ADJ}, c as (select kb_id, arg_max(node, (n, node)) as centre from (select kb_id, node, count(*) n from adj group by 1, 2) group by 1)
select distinct c.kb_id, centre, neighbour from c join adj on adj.node = c.centre""")
def neighbourhood(spark, sf_dir):
    """Around each base's best connected entity."""
    r = read(spark, sf_dir, "relationships")
    d = G.adjacency(r).groupBy("kb_id", "node").agg(F.count(F.lit(1)).alias("n"))
    return G.neighbourhood(r, d.groupBy("kb_id").agg(F.max_by("node", F.struct("n", "node")).alias("centre")))


@query("select kb_id, coalesce(entity_type, '概念') as entity_type, count(*) as entities from entities group by 1, 2")
def entity_types(spark, sf_dir):
    """The types of a base."""
    t = F.coalesce("entity_type", F.lit(G.DEFAULT_TYPE)).alias("entity_type")
    return read(spark, sf_dir, "entities").groupBy("kb_id", t).agg(F.count(F.lit(1)).alias("entities"))


@query("""with recursive ed as (select source_id a, target_id b from relationships where source_id is not null and target_id is not null union select target_id, source_id from relationships where source_id is not null and target_id is not null),
reach(a, b) as (select a, a from ed union select r.a, ed.b from reach r join ed on ed.a = r.b) select a as node, min(b) as component from reach group by 1""")
def graph_components(spark, sf_dir):
    """Connected components of the relations."""
    return components(read(spark, sf_dir, "relationships"), "source_id", "target_id")


@query()
def graph_communities(spark, sf_dir):
    """Label propagation (tested against a plain version)."""
    return G.communities(*_t(spark, sf_dir, "relationships", "entities"))


@query()
def community_ids(spark, sf_dir):
    """Communities named by a hash of their members, so an unchanged one keeps its name."""
    r, e = _t(spark, sf_dir, "relationships", "entities")
    return G.community_ids(G.communities(r, e), e)


@query()
def community_relations(spark, sf_dir):
    """Relations inside communities."""
    r = read(spark, sf_dir, "relationships")
    return G.internal_relations(G.communities(r), r)


@query()
def community_summaries(spark, sf_dir):
    """Titles and summaries without a model."""
    r, e = _t(spark, sf_dir, "relationships", "entities")
    return G.fallback_summaries(G.communities(r), e, r)


@query()
def changed_communities(spark, sf_dir):
    """What the newest tenth of the relations made of the communities: kept, new (with the vector of the new summary) or stale."""
    r, e = _t(spark, sf_dir, "relationships", "entities")
    cut = r.select(F.percentile_approx(F.unix_timestamp("created_at"), 0.9).alias("cut"))
    old = r.join(cut, F.unix_timestamp("created_at") <= F.col("cut")).drop("cut")
    stage = Stage(spark, "upkeep")
    found = stage.put(G.communities(r))
    now = stage.put(G.community_ids(found, e))
    state = G.upkeep(G.community_ids(G.communities(old), e), now)
    told = G.described(found, e, r).select("kb_id", "community", "title", "summary")
    new = state.where("state = 'new'").join(now.select("kb_id", "community_id", "community"), ["kb_id", "community_id"]).join(told, ["kb_id", "community"])
    vector = new.select("kb_id", "community_id", embed(F.concat_ws("\n", "title", "summary"), hashed_words()).alias("embedding"))
    return state.join(vector, ["kb_id", "community_id"], "left").withColumn("embedding_dim", F.coalesce(F.size("embedding"), F.lit(0)))


@query("""select kb_id, entity_type, count(*) as entities, count(name) as named, string_agg(name, '、' order by name, id) filter (where r <= 50) as first_names from (
select kb_id, id, name, coalesce(entity_type, '概念') as entity_type, row_number() over (partition by kb_id, coalesce(entity_type, '概念') order by name nulls last, id) r from entities) group by 1, 2""")
def members_by_type(spark, sf_dir):
    """Every type's size and, as a preview, its first 50 names; `type_members` has every member."""
    e = read(spark, sf_dir, "entities").withColumn("entity_type", F.coalesce("entity_type", F.lit(G.DEFAULT_TYPE)))
    size = e.groupBy("kb_id", "entity_type").agg(F.count(F.lit(1)).alias("entities"), F.count("name").alias("named"))
    top = e.where("name is not null").withColumn("_r", F.row_number().over(Window.partitionBy("kb_id", "entity_type").orderBy("name", "id"))).where("_r <= 50")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]), "、")
    names = top.groupBy(F.col("kb_id").alias("_kb"), F.col("entity_type").alias("_type")).agg(listed.alias("first_names"))
    rows = size.join(names, F.col("kb_id").eqNullSafe(F.col("_kb")) & (F.col("entity_type") == F.col("_type")), "left")
    return rows.select("kb_id", "entity_type", "entities", "named", "first_names")


@query("""select kb_id, coalesce(entity_type, '概念') as entity_type, row_number() over (partition by kb_id, coalesce(entity_type, '概念') order by name nulls first, id) - 1 as position,
count(*) over (partition by kb_id, coalesce(entity_type, '概念')) as members, id, name from entities""")
def type_members(spark, sf_dir):
    """Every member of every type of a base, one row each in order of name and id."""
    e = read(spark, sf_dir, "entities").select("kb_id", F.coalesce("entity_type", F.lit(G.DEFAULT_TYPE)).alias("entity_type"), "id", "name")
    return _placed(e, ["kb_id", "entity_type"]).select("kb_id", "entity_type", "position", "members", "id", "name")


@query()
def community_members(spark, sf_dir):
    """Every member of every community, one row each in order of name and id (tested against a plain version)."""
    r, e = _t(spark, sf_dir, "relationships", "entities")
    return _placed(G.members(G.communities(r, e), e), ["kb_id", "community"])


@query("""with recursive ed as (select source_id a, target_id b from relationships where source_id is not null and target_id is not null union select target_id, source_id from relationships where source_id is not null and target_id is not null),
reach(a, b) as (select a, a from ed union select r.a, ed.b from reach r join ed on ed.a = r.b), comp as (select a as node, min(b) as community from reach group by 1),
m as (select e.kb_id, community, e.id, e.name, coalesce(e.entity_type, '概念') as entity_type from comp join entities e on e.id = node),
g as (select *, row_number() over (partition by kb_id order by member_count desc, first_member) as rank from (select kb_id, community, count(*) as member_count, min(id) as first_member from m group by 1, 2))
select kb_id, rank, community, member_count, row_number() over (partition by kb_id, community order by name nulls first, id) - 1 as position, id, name, entity_type from g join m using (kb_id, community) where rank <= 100""")
def community_export(spark, sf_dir):
    """A base's 100 largest communities (here connected components) by size and first member, with every member in order."""
    r, e = _t(spark, sf_dir, "relationships", "entities")
    found = components(r, "source_id", "target_id").select(F.col("node").alias("entity_id"), F.col("component").alias("community"))
    found = found.join(e.select(F.col("id").alias("entity_id"), "kb_id"), "entity_id")
    top = G.by_size(found)
    rows = _placed(G.members(found, e).join(top.select("kb_id", "community"), ["kb_id", "community"], "left_semi"), ["kb_id", "community"])
    return rows.join(top, ["kb_id", "community"]).select("kb_id", F.col("rank").cast("long").alias("rank"), "community", "member_count", "position", "id", "name", "entity_type")


def _placed(rows, group):
    """``rows`` with position (from 0 by name and id) and members, the number of rows of the group."""
    rows = numbered(rows.withColumn("_g", F.struct(*group)), "_g", [F.col("name"), F.col("id")], "position")
    size = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("members"))
    n = size.withColumnRenamed("_g", "_h")
    return rows.join(n, rows["_g"].eqNullSafe(n["_h"])).drop("_g", "_h")


@query(f"select kb_id, {stamp('max(created_at)')} as newest, count(*) as relations, count(distinct source_id) as sources, sum(try_cast(round(weight * 1000) as bigint))::bigint as thousandths from relationships group by 1")
def relation_statistics(spark, sf_dir):
    """Relations of a base at a glance."""
    w = F.when(~F.isnan("weight"), F.round(F.col("weight") * 1000).cast("long"))
    rows = read(spark, sf_dir, "relationships").groupBy("kb_id")
    return rows.agg(F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("newest"), F.count(F.lit(1)).alias("relations"), F.countDistinct("source_id").alias("sources"), F.sum(w).alias("thousandths"))
