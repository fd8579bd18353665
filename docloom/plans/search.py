"""Retrieval queries. In those named after all_questions every chunk of the documents whose id is
divisible by 50 asks, with its whole content and a vector of any length, so work grows with the
data. In the others each base asks once, with its first 64-number chunk.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import graph as G
from docloom.operators import retrieval as R
from docloom.operators.components import components
from docloom.operators.ranking import numbered
from docloom.tables import Stage, read

from .base import query


def _queries(spark, sf_dir):
    c = read(spark, sf_dir, "chunks").where("embedding_dim = 64 and embedding is not null")
    first = c.groupBy("kb_id").agg(F.min_by(F.struct("id", "embedding", "content"), "id").alias("s"))
    return first.select("kb_id", F.col("s.id").alias("query_id"), F.col("s.content").alias("query_text"), F.col("s.embedding").alias("query_vector"))


def _all_questions(spark, sf_dir):
    c = read(spark, sf_dir, "chunks").where("document_id % 50 = 0 and embedding is not null")
    return c.select("kb_id", F.col("id").alias("query_id"), F.col("content").alias("query_text"), F.col("embedding").alias("query_vector"))


def _ranked(spark, sf_dir, k=6):
    return R.rank_by_base(read(spark, sf_dir, "chunks"), _queries(spark, sf_dir), k)


_Q = """with q as (select kb_id, id as query_id, content as query_text, embedding as query_vector from (select *, row_number() over (partition by kb_id order by id) r
from chunks where embedding_dim = 64 and embedding is not null) where r = 1),
scored as (select c.kb_id, query_id, c.id as chunk_id, round(list_inner_product(c.embedding::double[], query_vector::double[]), 5) as score
from chunks c join q using (kb_id) where len(c.embedding) = len(query_vector)),
ranks as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from scored),
ranked as (select * from ranks where rank <= 6)"""



def _all(sql: str) -> str:
    """The same SQL over all questions."""
    return "with q as (select kb_id, id as query_id, content as query_text, embedding as query_vector from chunks where document_id % 50 = 0 and embedding is not null),\nscored" + sql.split("\nscored", 1)[1]


_SEEDS = _Q + """, named as (select distinct q.kb_id, query_id, e.id as entity_id from q join entities e on e.kb_id = q.kb_id
where length(regexp_replace(lower(coalesce(e.normalized_name, e.name)), '^ +| +$', '', 'g')) >= 2
and contains(lower(query_text), regexp_replace(regexp_replace(lower(coalesce(e.normalized_name, e.name)), '[\\t\\n\\x0b\\f\\r \\x{85}\\p{Z}]+', ' ', 'g'), '^ +| +$', '', 'g'))),
seed as (select distinct r.kb_id, r.query_id, x.entity_id from ranked r join entity_chunks x using (chunk_id) join entities e on e.id = x.entity_id and e.kb_id = r.kb_id),
seeds as (select * from seed union select * from named)"""

_FACTS = _SEEDS + """, rel as (select distinct on (id) id, source_id, target_id, coalesce(nullif(trim(predicate), ''), '相关') as predicate, coalesce(description, '') as description,
case when weight is null then 1.0 when weight::varchar = 'nan' then 0.1 else least(10.0, greatest(0.1, weight)) end as weight
from relationships where source_id is not null and target_id is not null and source_id <> target_id),
hit as (select distinct query_id, r.id from rel r join seeds s on s.entity_id = r.source_id or s.entity_id = r.target_id),
facts as (select * from (select query_id, row_number() over (partition by query_id order by weight desc, r.id) as rank, r.id, source_id, target_id, s.name as source, t.name as target, predicate, r.description, weight
from hit join rel r using (id) join entities s on s.id = source_id join entities t on t.id = target_id) where rank <= 16)"""

_RELATED = _FACTS + """, wide as (select query_id, entity_id from seeds union select query_id, source_id from facts union select query_id, target_id from facts),
m as (select entity_id, chunk_id, max(mention_count) mention_count from entity_chunks group by 1, 2),
related as (select * from (select query_id, chunk_id, relevance, row_number() over (partition by query_id order by relevance desc, chunk_id) as rank from
(select query_id, chunk_id, sum(mention_count)::bigint as relevance from wide join m using (entity_id) group by 1, 2)) where rank <= 6)"""

_HYBRID = _RELATED + """, hybrid as (select query_id, chunk_id, score, rank from (select query_id, chunk_id, score, row_number() over (partition by query_id order by s, rank) as rank from (
select query_id, chunk_id, score, 0 as s, rank from ranked union all select query_id, chunk_id, 0.0, 1, rank from related x where not exists (select 1 from ranked r where r.query_id = x.query_id and r.chunk_id = x.chunk_id))) where rank <= 6)"""


def _first_vector(e) -> list[float]:
    """The vector with id 0; without one an empty list, to which nothing is similar."""
    row = e.where("vec_id = 0").first()
    return list(row.embedding) if row and row.embedding else []


@query("""select vec_id, round(list_inner_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 5) as score from embeddings order by score desc, vec_id limit 6""")
def vector_topk(spark, sf_dir):
    """The vectors most like the first one."""
    e = read(spark, sf_dir, "embeddings")
    return R.top_k(e, "vec_id", "embedding", _first_vector(e))


@query("""select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
select q.vec_id as query_id, e.vec_id, round(list_inner_product(e.embedding::double[], q.embedding::double[]), 5) as score from embeddings e, embeddings q where q.vec_id % 50 = 0)) where rank <= 6""")
def vector_topk_batch(spark, sf_dir):
    """R1 for the vectors whose id is divisible by 50, against all, in blocks."""
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return R.batch_top_k(e, q, "vec_id", "embedding").withColumn("rank", F.col("rank").cast("long"))


@query(_Q + " select kb_id, query_id, chunk_id, score, rank from ranked")
def vector_topk_by_base(spark, sf_dir):
    """Each base's search."""
    return _ranked(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


_RERANK = _Q + """, cand as (select * from ranks where rank <= 18), words as (select query_id, list_distinct(list_filter(string_split_regex(lower(query_text), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+'), lambda w: length(w) > 0)) w from q)
select kb_id, query_id, chunk_id, score, rerank_score, rank from (select c.kb_id, query_id, chunk_id, score, round(len(list_filter(w, lambda x: contains(lower(k.content), x))) / greatest(1, len(w)), 5) as rerank_score,
row_number() over (partition by query_id order by round(len(list_filter(w, lambda x: contains(lower(k.content), x))) / greatest(1, len(w)), 5) desc, c.rank) as rank
from cand c join words using (query_id) join chunks k on k.id = c.chunk_id) where rank <= 6"""


@query(_RERANK)
def rerank_by_base(spark, sf_dir):
    """18 candidates by vector, 6 by a lexical score."""
    q = _queries(spark, sf_dir)
    c = read(spark, sf_dir, "chunks")
    return R.rerank(R.rank_by_base(c, q, 18), c, q).withColumn("rank", F.col("rank").cast("long"))


@query(_SEEDS + " select query_id, entity_id from seed")
def seed_entities(spark, sf_dir):
    """Entities of the chunks found."""
    return R.seed_entities(_ranked(spark, sf_dir), read(spark, sf_dir, "entity_chunks"), read(spark, sf_dir, "entities")).select("query_id", "entity_id")


@query(_SEEDS + " select query_id, entity_id from named")
def entities_named_in_query(spark, sf_dir):
    """Entities whose name stands in the question."""
    return R.named_entities(_queries(spark, sf_dir), read(spark, sf_dir, "entities")).select("query_id", "entity_id")


def _local(spark, sf_dir):
    """(seeds, facts, mentions) of each base's question; the first two are written once."""
    c, e, x, r = (read(spark, sf_dir, n) for n in ("chunks", "entities", "entity_chunks", "relationships"))
    q = Stage(spark, "questions").put(_queries(spark, sf_dir))
    return *R.local(q, R.rank_by_base(c, q), e, x, r), x


@query(_FACTS + " select query_id, rank, id, source, target, predicate, weight from facts")
def local_facts(spark, sf_dir):
    """The heaviest relations around the seeds."""
    return _local(spark, sf_dir)[1].select("query_id", F.col("rank").cast("long").alias("rank"), "id", "source", "target", "predicate", "weight")


@query(_RELATED + " select query_id, chunk_id, relevance, rank from related")
def related_chunks(spark, sf_dir):
    """Chunks by the mentions of the widened seeds."""
    seeds, facts, x = _local(spark, sf_dir)
    return R.related_chunks(seeds, facts, x).withColumn("rank", F.col("rank").cast("long"))


@query(_HYBRID + " select query_id, chunk_id, score, rank from hybrid")
def hybrid_search(spark, sf_dir):
    """Vector and graph together."""
    t = [read(spark, sf_dir, n) for n in ("chunks", "entities", "entity_chunks", "relationships")]
    return R.search("hybrid", _queries(spark, sf_dir), *t).withColumn("rank", F.col("rank").cast("long"))


@query(_all(_RERANK))
def rerank_all_questions(spark, sf_dir):
    """R2, R3, J13 for every question."""
    q, c = _all_questions(spark, sf_dir), read(spark, sf_dir, "chunks")
    return R.rerank(R.rank_by_base(c, q, 18), c, q).withColumn("rank", F.col("rank").cast("long"))


@query(_all(_SEEDS) + " select query_id, entity_id from named")
def entities_named_in_all_questions(spark, sf_dir):
    """J8 for every question."""
    return R.named_entities(_all_questions(spark, sf_dir), read(spark, sf_dir, "entities")).select("query_id", "entity_id")


def _local_all(spark, sf_dir):
    q, (c, e, x, r) = _all_questions(spark, sf_dir), (read(spark, sf_dir, n) for n in ("chunks", "entities", "entity_chunks", "relationships"))
    return R.local(q, R.rank_by_base(c, q), e, x, r)


@query(_all(_FACTS) + " select query_id, rank, id, source, target, predicate, weight from facts")
def facts_of_all_questions(spark, sf_dir):
    """R5, J4, J14 for every question."""
    return _local_all(spark, sf_dir)[1].select("query_id", F.col("rank").cast("long").alias("rank"), "id", "source", "target", "predicate", "weight")


@query(_all(_RELATED) + " select query_id, chunk_id, relevance, rank from related")
def related_to_all_questions(spark, sf_dir):
    """R6, A5 for every question."""
    return R.related_chunks(*_local_all(spark, sf_dir), read(spark, sf_dir, "entity_chunks")).withColumn("rank", F.col("rank").cast("long"))


@query(_all(_HYBRID) + " select query_id, chunk_id, score, rank from hybrid")
def hybrid_all_questions(spark, sf_dir):
    """R7, R8, J15 for every question."""
    t = [read(spark, sf_dir, n) for n in ("chunks", "entities", "entity_chunks", "relationships")]
    return R.search("hybrid", _all_questions(spark, sf_dir), *t).withColumn("rank", F.col("rank").cast("long"))


# Connected components stand for communities where SQL must say the same; label propagation has no SQL.
_PARTS = """, ed as (select source_id a, target_id b from rel union select target_id, source_id from rel), reach(a, b) as (select a, a from ed union select r.a, ed.b from reach r join ed on ed.a = r.b),
comp as (select a as node, min(b) as community from reach group by 1),
memb as (select e.kb_id, community, e.id, e.name, coalesce(e.entity_type, '概念') as entity_type, coalesce(e.description, '') as description, row_number() over (partition by e.kb_id, community order by e.name nulls first, e.id) as r from comp join entities e on e.id = node),
up as (select kb_id, source_id, target_id, predicate, arg_min(id, (created_at, id)) as id, max(weight) as weight, arg_min(description, (-length(description), created_at, id)) as description from rel group by 1, 2, 3, 4),
inner_rel as (select u.*, s.community, sn.name as sname, tn.name as tname, row_number() over (partition by u.kb_id, s.community order by weight desc, predicate, u.id) as r
from up u join comp s on s.node = source_id join comp t on t.node = target_id and t.community = s.community join entities sn on sn.id = source_id join entities tn on tn.id = target_id),
told as (select kb_id, community, string_agg('- ' || sname || ' —' || predicate || '→ ' || tname || '：' || description, '；' order by r) as s from inner_rel where r <= 6 group by 1, 2),
titled as (select kb_id, community, count(*) as member_count, substr(string_agg(name, '、' order by r) filter (where r <= 3), 1, 80) as title,
string_agg('- ' || name || '（' || entity_type || '）：' || description, '；' order by r) filter (where r <= 6) as ents from memb group by 1, 2),
descr as (select t.kb_id, t.community, title, member_count, substr(coalesce(told.s, ents), 1, 2000) as summary from titled t left join told on told.kb_id = t.kb_id and told.community = t.community),
heard as (select distinct kb_id, community, chunk_id from memb join entity_chunks x on x.entity_id = memb.id),
vals as (select h.kb_id, community, unnest(range(64)) as i, unnest(c.embedding::double[]) as v from heard h join chunks c on c.id = h.chunk_id where len(c.embedding) = 64),
means as (select kb_id, community, i, avg(v) as v from vals group by 1, 2, 3), sizes as (select kb_id, community, sqrt(sum(v * v)) as n from means group by 1, 2),
asked as (select kb_id, query_id, unnest(range(64)) as i, unnest(query_vector::double[]) as x from q),
near as (select a.query_id, m.kb_id, m.community, round(sum(a.x * m.v / n), 5) as score from asked a join means m on m.kb_id = a.kb_id and m.i = a.i join sizes z on z.kb_id = m.kb_id and z.community = m.community where n > 0 group by 1, 2, 3),
world as (select * from (select query_id, row_number() over (partition by query_id order by score desc, near.community) as rank, near.community, title, summary, member_count, score from near join descr using (kb_id, community)) where rank <= 4)"""
_REL_ALL = _FACTS.replace("with q as", "with recursive q as", 1).replace("rel as (select distinct on (id) id, source_id", "rel as (select distinct on (id) id, kb_id, created_at, source_id")


def _communities(spark, sf_dir):
    c, e, x, r = (read(spark, sf_dir, n) for n in ("chunks", "entities", "entity_chunks", "relationships"))
    both = G.clean_relations(r)
    m = components(both, "source_id", "target_id").select(F.col("node").alias("entity_id"), F.col("component").alias("community"))
    m = Stage(spark, "groups").put(m.join(e.select(F.col("id").alias("entity_id"), "kb_id"), "entity_id"))
    v = R.community_vectors(m, x, c)
    return G.described(m, e, r).join(v, ["kb_id", "community"], "left")


@query(_REL_ALL + _PARTS + " select query_id, rank, community, title, member_count, score, md5(summary) as summary from world")
def global_search(spark, sf_dir):
    """R4, R8 (graph_global): the communities (here connected components) most like each question."""
    t = [read(spark, sf_dir, n) for n in ("chunks", "entities", "entity_chunks", "relationships")]
    found = R.search("graph_global", _queries(spark, sf_dir), *t, communities=_communities(spark, sf_dir))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "community", "title", "member_count", "score", F.md5("summary").alias("summary"))


@query()
def global_search_communities(spark, sf_dir):
    """R4, R8 (graph_global) over the communities that label propagation finds, for every question."""
    c, e, x, r = (read(spark, sf_dir, n) for n in ("chunks", "entities", "entity_chunks", "relationships"))
    m = Stage(spark, "groups").put(G.communities(r))
    told = G.described(m, e, r).join(R.community_vectors(m, x, c), ["kb_id", "community"], "left")
    return R.search("graph_global", _all_questions(spark, sf_dir), c, e, x, r, communities=told)


@query(_REL_ALL + _PARTS + """, parts as (
select query_id, 0 as kind, rank, '[来源' || rank || '] 文件：' || coalesce(d.filename, '') || case when c.page_number > 0 then '，第' || c.page_number || '页' else '' end || chr(10) || coalesce(c.content, '') as line
from ranked r join chunks c on c.id = r.chunk_id join documents d on d.doc_id = c.document_id
union all select query_id, 1, rank, '[图关系' || rank || '] ' || coalesce(source, '') || ' —' || predicate || '→ ' || coalesce(target, '') || '。' || description from facts
union all select query_id, 2, rank, '[图社区' || rank || '] ' || coalesce(title, '') || '（' || member_count || ' 个实体）' || chr(10) || coalesce(summary, '') from world)
select q.query_id, coalesce(string_agg(line, chr(10) || chr(10) order by kind, rank), '（未检索到相关证据）') as context from q left join parts using (query_id) group by 1""")
def search_context(spark, sf_dir):
    """Numbered sources, facts and communities for an answer; also that there are none."""
    c, d, e, x, r = (read(spark, sf_dir, n) for n in ("chunks", "documents", "entities", "entity_chunks", "relationships"))
    q = Stage(spark, "questions").put(_queries(spark, sf_dir))
    ranked = R.rank_by_base(c, q)
    _, facts = R.local(q, ranked, e, x, r)
    return R.context(q, ranked, c, d, facts, R.global_context(q, _communities(spark, sf_dir)))


@query("""with t as (select kb_id as conversation, row_number() over (partition by kb_id order by created_at nulls first, doc_id) as turn,
case doc_id % 3 when 0 then 'user' when 1 then 'assistant' else 'system' end as role, text as content from documents),
n as (select * from (select *, row_number() over (partition by conversation order by turn desc) r from t) where r <= 20 and role in ('user', 'assistant') and length(content) > 0),
u as (select conversation, turn, role, substr(content, 1, 6000) c, coalesce(sum(least(6000, length(content))) over (partition by conversation order by turn desc rows between unbounded preceding and 1 preceding), 0) used from n)
select conversation, turn, role, md5(substr(c, 1, (24000 - used)::bigint)) as hash, length(substr(c, 1, (24000 - used)::bigint)) as size from u where used < 24000""")
def history_window(spark, sf_dir):
    """The prompt's history; a base's documents in order stand for the turns of a talk."""
    d = read(spark, sf_dir, "documents")
    role = F.when(F.col("doc_id") % 3 == 0, "user").when(F.col("doc_id") % 3 == 1, "assistant").otherwise("system")
    place = numbered(d.select("kb_id", "doc_id", "created_at"), "kb_id", [F.col("created_at"), F.col("doc_id")], "place").select("doc_id", "place")
    turns = d.join(place, "doc_id").select(F.col("kb_id").alias("conversation"), (F.col("place") + 1).alias("turn"), role.alias("role"), F.col("text").alias("content"))
    return R.history(turns).select("conversation", "turn", "role", F.md5("content").alias("hash"), F.length("content").cast("long").alias("size"))


@query("""with x as (select label, unnest(range(64)) i, unnest(embedding::double[]) v from embeddings), m as (select label, i, avg(v) v from x group by 1, 2),
q as (select unnest(range(64)) i, unnest(embedding::double[]) q from embeddings where vec_id = 0)
select label, n as members, round(s, 5) as score from (select label, sum(v * q) s from m join q using (i) group by 1) join (select label, count(*) n from embeddings group by 1) using (label) order by score desc, label limit 4""")
def community_topk(spark, sf_dir):
    """Groups whose mean vector is most like the query."""
    e = read(spark, sf_dir, "embeddings")
    return R.community_top_k(e, "label", "embedding", _first_vector(e)).select("label", "members", "score")
