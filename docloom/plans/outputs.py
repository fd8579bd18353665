"""Queries for the exported datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.exports import lines as L
from docloom.functions import text as T
from docloom.operators import checkpoints as C
from docloom.operators import graph as G
from docloom.operators.components import components
from docloom.operators.ranking import numbered
from docloom.tables import read

from .base import query, stamp
from .graph import _PAGE, _REL, _page, _up
from .states import _LAST


def _cell(c: str) -> str:
    return f"replace(replace(replace(coalesce({c}::varchar, ''), '|', '\\|'), chr(13), ' '), chr(10), '<br>')"


@query(f"select id, '| ' || {_cell('id')} || ' | ' || {_cell('name')} || ' | ' || {_cell('entity_type')} || ' | ' || {_cell('description')} || ' |' as line from entities")
def entity_markdown(spark, sf_dir):
    """K6: entities as rows of a Markdown table."""
    e = read(spark, sf_dir, "entities")
    return e.select("id", L.markdown_rows(e, ["id", "name", "entity_type", "description"]).alias("line"))


@query(f"select doc_id, '| ' || {_cell('filename')} || ' | ' || {_cell('sha256')} || ' | ' || {_cell('status')} || ' | ' || {_cell('page_count')} || ' |' as line from documents")
def document_catalogue(spark, sf_dir):
    """The catalogue of documents."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", L.markdown_rows(d, ["filename", "sha256", "status", "page_count"]).alias("line"))


@query("""select c.id as chunk_id, md5('## ' || coalesce(d.filename, '') || ' · Chunk ' || (c.chunk_index + 1) || case when c.page_number > 0 then ' · 第 ' || c.page_number || ' 页' else '' end || chr(10) || chr(10) || coalesce(c.content, '')) as hash
from chunks c join documents d on d.doc_id = c.document_id""")
def chunk_markdown(spark, sf_dir):
    """Chunks of all documents, whatever their state, under headings."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "filename")
    c = read(spark, sf_dir, "chunks").join(d, "document_id")
    page = F.when(F.col("page_number") > 0, F.concat(F.lit(" · 第 "), F.col("page_number").cast("string"), F.lit(" 页"))).otherwise("")
    line = F.concat(F.lit("## "), F.coalesce("filename", F.lit("")), F.lit(" · Chunk "), (F.col("chunk_index") + 1).cast("string"), page, F.lit("\n\n"), F.coalesce("content", F.lit("")))
    return c.select(F.col("id").alias("chunk_id"), F.md5(line).alias("hash"))


@query()
def chunk_json_lines(spark, sf_dir):
    """K3, K4: chunks as JSON lines (the SQL engines write numbers and escapes differently)."""
    c = read(spark, sf_dir, "chunks")
    kept = F.struct("id", "document_id", "chunk_index", "page_number", "token_count", T.metadata(F.col("metadata_json")).alias("metadata"), "content")
    return c.select(F.col("id").alias("chunk_id"), F.to_json(kept).alias("line"))


@query()
def vector_lines(spark, sf_dir):
    """Vectors as text."""
    c = read(spark, sf_dir, "chunks").where("embedding is not null")
    return c.select(F.col("id").alias("chunk_id"), "embedding_dim", L.vector_text(F.col("embedding")).alias("numbers"))


@query(f"""with {_LAST} select l.kb_id, l.position, l.chunk_id, d.filename, c.chunk_index, l.status, l.attempts from last l join chunks c on c.id = l.chunk_id join documents d on d.doc_id = c.document_id""")
def checkpoints_export(spark, sf_dir):
    """The build's checkpoints with their places."""
    s = C.latest(read(spark, sf_dir, "graph_build_chunks"))
    c = read(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), "document_id", "chunk_index")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "filename")
    return s.join(c, "chunk_id").join(d, "document_id").select("kb_id", "position", "chunk_id", "filename", "chunk_index", "status", "attempts")


_COMP = """ed as (select source_id a, target_id b from relationships where source_id is not null and target_id is not null union select target_id, source_id from relationships where source_id is not null and target_id is not null),
reach(a, b) as (select a, a from ed union select r.a, ed.b from reach r join ed on ed.a = r.b), comp as (select a as node, min(b) as community from reach group by 1),
cn as (select kb_id, count(distinct community) as n from comp join entities e on e.id = node group by 1)"""
_COUNTED = ("documents", "chunks", "entities", "relationships", "graph_build_chunks")


def _sizes(spark, sf_dir):
    """Every base with the sizes of its tables and the number of its communities (here connected components)."""
    found = components(read(spark, sf_dir, "relationships"), "source_id", "target_id").withColumnRenamed("node", "id")
    groups = found.join(read(spark, sf_dir, "entities").select("id", "kb_id"), "id").select("kb_id", "component").distinct()
    out = read(spark, sf_dir, "knowledge_bases").withColumnRenamed("id", "kb_id")
    for name, t in [*((n, read(spark, sf_dir, n)) for n in _COUNTED), ("communities", groups)]:
        out = out.join(t.groupBy("kb_id").agg(F.count(F.lit(1)).alias(name)), "kb_id", "left")
    return out.fillna(0, [*_COUNTED, "communities"])


_SIZES = "with recursive " + _COMP + ", s as (select k.*, " + ", ".join(f"coalesce({t}.n, 0) as {t}" for t in _COUNTED) + ", coalesce(cn.n, 0) as communities from knowledge_bases k " + " ".join(
    f"left join (select kb_id, count(*) n from {t} group by 1) {t} on {t}.kb_id = k.id" for t in _COUNTED
) + " left join cn on cn.kb_id = k.id)"


@query(_SIZES + f""" select id as kb_id, name, description, documents as document_count, chunks as chunk_count, entities as entity_count, relationships as relationship_count, communities as community_count,
graph_status, graph_stage, graph_progress_current, graph_progress_total, graph_failed_chunks, graph_error, {stamp('created_at')} as created_at, {stamp('updated_at')} as updated_at,
'# ' || name || chr(10) || chr(10) || coalesce(nullif(description, ''), '（无描述）') || chr(10) || chr(10) || '## 规模' || chr(10) || chr(10) || '- 文档：' || documents || chr(10) || '- 文本块：' || chunks || chr(10) || '- 实体：' || entities
|| chr(10) || '- 关系：' || relationships || chr(10) || '- 图社区：' || communities || chr(10) || chr(10) || '## 图谱状态' || chr(10) || chr(10) || '- 状态：' || coalesce(graph_status, '') || chr(10) || '- 阶段：' || coalesce(nullif(graph_stage, ''), '—')
|| chr(10) || '- 进度：' || coalesce(graph_progress_current, 0) || '/' || coalesce(graph_progress_total, 0) || chr(10) || '- 未完成块：' || coalesce(graph_failed_chunks, 0) || case when length(graph_error) > 0 then chr(10) || chr(10) || '> ' || graph_error else '' end as summary from s""")
def base_summary(spark, sf_dir):
    """K8: a base's fields and sizes, also as a short text."""
    k = _sizes(spark, sf_dir)
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    text = lambda c, blank: F.coalesce(F.when(F.length(c) > 0, F.col(c)), F.lit(blank))
    lines = [
        F.concat(F.lit("# "), "name"), F.lit(""), text("description", "（无描述）"), F.lit(""), F.lit("## 规模"), F.lit(""), F.concat(F.lit("- 文档："), n("documents")), F.concat(F.lit("- 文本块："), n("chunks")),
        F.concat(F.lit("- 实体："), n("entities")), F.concat(F.lit("- 关系："), n("relationships")), F.concat(F.lit("- 图社区："), n("communities")), F.lit(""), F.lit("## 图谱状态"), F.lit(""),
        F.concat(F.lit("- 状态："), text("graph_status", "")), F.concat(F.lit("- 阶段："), text("graph_stage", "—")), F.concat(F.lit("- 进度："), n("graph_progress_current"), F.lit("/"), n("graph_progress_total")),
        F.concat(F.lit("- 未完成块："), n("graph_failed_chunks")), F.when(F.length("graph_error") > 0, F.concat(F.lit("\n> "), "graph_error")),
    ]
    counts = [F.col(c).alias(f"{o}_count") for c, o in zip([*_COUNTED[:4], "communities"], ("document", "chunk", "entity", "relationship", "community"))]
    return k.select(
        "kb_id", "name", "description", *counts, "graph_status", "graph_stage", "graph_progress_current", "graph_progress_total", "graph_failed_chunks", "graph_error", when("created_at"), when("updated_at"),
        F.concat_ws("\n", *lines).alias("summary"),
    )


_KINDS = {"snapshot": None, "summary": None, "originals": "documents", "documents": "documents", "chunks": "chunks", "vectors": "chunks", "entities": "entities", "relationships": "relationships", "graph": "entities", "communities": "communities", "checkpoints": "graph_build_chunks"}


@query(_SIZES + " " + " union all ".join(f"select id as kb_id, '{k}' as kind, {t or 1}::bigint as count, {f'{t} > 0' if t else 'true'} as available from s" for k, t in _KINDS.items()))
def export_options(spark, sf_dir):
    """K1: what can be exported of a base, and how much of it there is."""
    items = [F.struct(F.lit(k).alias("kind"), (F.col(t) if t else F.lit(1)).cast("long").alias("count"), ((F.col(t) > 0) if t else F.lit(True)).alias("available")) for k, t in _KINDS.items()]
    return _sizes(spark, sf_dir).select("kb_id", F.explode(F.array(*items)).alias("o")).select("kb_id", "o.kind", "o.count", "o.available")


@query("""select doc_id, case when r = 1 then f else regexp_replace(f, '(\\.[^.]*)?$', '-' || r || '\\1') end as entry from (
select doc_id, f, row_number() over (partition by kb_id, lower(f) order by doc_id) r from (select doc_id, kb_id, coalesce(filename, 'document') f from documents))""")
def archive_names(spark, sf_dir):
    """K9: names of files in an archive, equal ones numbered."""
    d = read(spark, sf_dir, "documents").select("doc_id", "kb_id", F.coalesce("filename", F.lit("document")).alias("f"))
    d = numbered(d.withColumn("_g", F.struct("kb_id", F.lower("f"))), "_g", [F.col("doc_id")], "r").withColumn("r", F.col("r") + 1)
    stem, ext = F.regexp_extract("f", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("f", r"^(.*?)(\.[^.]*)?$", 2)
    return d.select("doc_id", F.when(F.col("r") == 1, F.col("f")).otherwise(F.concat(stem, F.lit("-"), F.col("r").cast("string"), ext)).alias("entry"))


@query(f"""with {_PAGE}, n as (select *, count(*) over (partition by kb_id) c from nodes) select kb_id, id,
round(1200 + cos((rank - 1) * pi() * (3 - sqrt(5))) * case when c <= 1 then 0 else 50 + sqrt((rank - 1) / greatest(1, c - 1)) * (1600 * 0.44 - 50) end, 3) as x,
round(800 + sin((rank - 1) * pi() * (3 - sqrt(5))) * case when c <= 1 then 0 else 50 + sqrt((rank - 1) / greatest(1, c - 1)) * (1600 * 0.44 - 50) end, 3) as y from n""")
def graph_layout(spark, sf_dir):
    """Places of the page's nodes."""
    return L.layout(_page(spark, sf_dir)[0]).select("kb_id", "id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("""select id, ['#477ae8', '#df6c42', '#87a91c', '#8c61c9', '#299d8f', '#c65c8b', '#69736d'][(coalesce(list_sum(list_transform(string_split(coalesce(entity_type, ''), ''), lambda x: case when length(x) > 0 then unicode(x) else 0 end)), 0) % 7 + 1)::bigint] as colour from entities""")
def node_colours(spark, sf_dir):
    """A colour for each type."""
    return read(spark, sf_dir, "entities").select("id", L.colour(F.col("entity_type")).alias("colour"))


def _graph(spark, sf_dir):
    return read(spark, sf_dir, "entities"), G.relation_upsert(read(spark, sf_dir, "relationships"))


_X = lambda c: f"replace(replace(replace(replace(coalesce({c}::varchar, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"
_UP = f"with {_REL}, u as (select * from {_up()}), b as (select distinct kb_id from entities union select kb_id from u)"


def _framed(**parts: str) -> str:
    return "".join(f" union all select kb_id, {p[4:]}, '', '{text}' from b" for p, text in parts.items())


@query(f"""{_UP} select kb_id, 1 as part, id, '<node id="' || {_X('id')} || '"><data key="name">' || {_X('name')} || '</data><data key="type">' || {_X('entity_type')} || '</data><data key="description">' || {_X('description')} || '</data></node>' as line from entities
union all select kb_id, 2, id, '<edge id="' || {_X('id')} || '" source="' || source_id || '" target="' || target_id || '"><data key="predicate">' || {_X('predicate')} || '</data><data key="description">' || {_X('description')} || '</data><data key="weight">' || weight || '</data></edge>' from u"""
+ _framed(part0=L._GRAPHML, part3="</graph>\n</graphml>"))
def graph_graphml(spark, sf_dir):
    """All entities and relations of each base as a GraphML document."""
    return L.graphml(*_graph(spark, sf_dir)).drop("rank")


@query(f"""{_UP} select kb_id, 1 as part, id, '<node id="' || {_X('id')} || '" label="' || {_X('name')} || '"/>' as line from entities
union all select kb_id, 3, id, '<edge id="' || {_X('id')} || '" source="' || source_id || '" target="' || target_id || '" label="' || {_X('predicate')} || '" weight="' || weight || '"/>' from u"""
+ _framed(part0=L._GEXF, part2="</nodes>\n<edges>", part4="</edges>\n</graph>\n</gexf>"))
def graph_gexf(spark, sf_dir):
    """All entities and relations of each base as a GEXF document."""
    return L.gexf(*_graph(spark, sf_dir)).drop("rank")


@query()
def graph_json(spark, sf_dir):
    """All entities and relations of each base as one JSON object."""
    return L.graph_json(*_graph(spark, sf_dir))


@query()
def graph_mermaid(spark, sf_dir):
    """A Markdown document of each base with a flow chart and all entities and relations."""
    e, x, k = (read(spark, sf_dir, n) for n in ("entities", "entity_chunks", "knowledge_bases"))
    return L.graph_markdown(k.select(F.col("id").alias("kb_id"), F.col("name").alias("title")), G.entity_mentions(e, x), _graph(spark, sf_dir)[1])


@query()
def graph_svg(spark, sf_dir):
    """A picture of each base's page with the names of its best connected nodes."""
    return L.svg(*_page(spark, sf_dir))
