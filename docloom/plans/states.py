"""Queries over the build log and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import checkpoints as C
from docloom.operators.ranking import numbered
from docloom.streaming import ingest
from docloom.tables import read

from .base import query, stamp

_LAST = """last as (select kb_id, chunk_id, s.status as status, s.error as error, s.attempts as attempts, s.position as position, s.updated_at as updated_at from (
select kb_id, chunk_id, arg_max(struct_pack(status, error, attempts, position, updated_at), (updated_at, seq)) s from graph_build_chunks group by 1, 2))"""


def _latest(spark, sf_dir):
    return C.latest(read(spark, sf_dir, "graph_build_chunks"))


@query(f"with {_LAST} select kb_id, chunk_id, status, error, attempts, position, {stamp('updated_at')} as updated_at from last")
def checkpoint_latest(spark, sf_dir):
    """Each chunk's state."""
    return _latest(spark, sf_dir).withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""with {_LAST} select kb_id, count(*) as total, count_if(status in ('succeeded', 'failed')) as processed, count_if(status = 'succeeded') as succeeded,
count_if(status = 'failed') as failed, count_if(status = 'succeeded') / count(*) as success_ratio from last group by 1""")
def checkpoint_stats(spark, sf_dir):
    """Progress of each base."""
    return C.stats(_latest(spark, sf_dir))


@query(f"""with {_LAST} select l.kb_id, l.chunk_id, c.document_id, d.filename, c.chunk_index, l.position, l.attempts from last l join chunks c on c.id = l.chunk_id
join documents d on d.doc_id = c.document_id where l.status <> 'succeeded' and d.status = 'ready'""")
def pending_chunks(spark, sf_dir):
    """What is left to do."""
    return C.pending(_latest(spark, sf_dir), read(spark, sf_dir, "chunks"), read(spark, sf_dir, "documents"))


@query(f"with {_LAST} select kb_id, chunk_id, case when chunk_id in (select chunk_id from entity_chunks where chunk_id is not null) then 'succeeded' else status end as status from last")
def recovered_states(spark, sf_dir):
    """Chunks that gave entities count as done."""
    return C.recovered(_latest(spark, sf_dir), read(spark, sf_dir, "entity_chunks"))


@query("""select kb_id, count_if(late) as late_rows, count(*) as rows from (select kb_id, updated_at < max(updated_at) over (partition by kb_id, chunk_id order by seq rows between unbounded preceding and 1 preceding) as late from graph_build_chunks) group by 1""")
def late_rows(spark, sf_dir):
    """Rows that came after a newer one of their chunk."""
    return C.late_rows(read(spark, sf_dir, "graph_build_chunks"))


@query(f"""with {_LAST}, s as (select kb_id, count(*) as total, count_if(status in ('succeeded', 'failed')) as done, max(updated_at) as newest from last group by 1)
select kb_id, least(100, round(100.0 * done / total))::bigint as percent, total - done as unfinished, row_number() over (order by newest desc nulls last, kb_id) as listed from s""")
def progress_percent(spark, sf_dir):
    """Each base's progress by its build log, bases listed by their last change."""
    s = F.col("status").isin("succeeded", "failed")
    rows = _latest(spark, sf_dir).groupBy("kb_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(s).alias("done"), F.max("updated_at").alias("newest"))
    rows = numbered(rows.withColumn("_all", F.lit(0)), "_all", [F.desc_nulls_last("newest"), F.col("kb_id")], "listed")
    return rows.select("kb_id", T.progress_percent(F.col("done"), F.col("total")).alias("percent"), (F.col("total") - F.col("done")).alias("unfinished"), (F.col("listed") + 1).alias("listed"))


@query("select attempts, status, count(*) as rows, count(distinct kb_id) as bases from graph_build_chunks group by 1, 2")
def attempt_counts(spark, sf_dir):
    """How often chunks were tried."""
    return read(spark, sf_dir, "graph_build_chunks").groupBy("attempts", "status").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("kb_id").alias("bases"))


@query("select event_type, count(*) as events, round(sum(value), 2) as total from events group by 1")
def stream_counts(spark, sf_dir):
    """The same counts by a stream that takes what is there and ends."""
    return ingest.counts(spark, f"{sf_dir}/events.parquet")


@query("""with w as (select id, unnest(l) as w, generate_subscripts(l, 1) as i from (select id, regexp_extract_all(content, '[A-Z][a-z]{3,}') as l from chunks where content is not null)),
f as (select id, w, row_number() over (partition by id order by min(i)) as r from w group by 1, 2) select id as chunk_id, lower(w) as name from f where r <= 12""")
def streamed_extraction(spark, sf_dir):
    """Chunks taken by a stream in waves, each answered by an extractor (here capitalised words) and read into the entity log."""
    return ingest.extracted(spark, f"{sf_dir}/chunks.parquet", ingest.capitalised).select("chunk_id", F.col("normalized_name").alias("name"))


@query("select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) as events from events group by 1, 2")
def stream_windows(spark, sf_dir):
    """Hourly windows with a watermark, by a stream."""
    return ingest.hourly(spark, f"{sf_dir}/events.parquet")


@query("select doc_id, arg_max(category, (n, category)) as category, max(n) as votes, sum(n)::bigint as raters from (select doc_id, category, count(*) n from labels where category is not null group by 1, 2) group by 1")
def label_majority(spark, sf_dir):
    """The raters' majority on each document."""
    n = read(spark, sf_dir, "labels").where("category is not null").groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("doc_id").agg(F.max_by("category", F.struct("n", "category")).alias("category"), F.max("n").alias("votes"), F.sum("n").alias("raters"))
