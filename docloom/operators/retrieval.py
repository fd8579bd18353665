"""Retrieval for many queries at once: vectors, graph and both, as joins and ranked windows.

A query is a row (kb_id, query_id, query_text, query_vector); one interactive query is the
special case of one row. Ranks are window functions with a limit, which Spark prunes before
the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.tables import Stage

from .graph import clean_relations, mentions


def top_k(vectors: DataFrame, key: str, vector: str, query: list[float], k: int = 6) -> DataFrame:
    """key, score: the k best inner products with one query vector; other lengths are skipped."""
    q = F.array(*(F.lit(float(x)) for x in query)).cast("array<double>")
    rows = vectors.where(F.size(vector) == len(query)).select(key, F.round(V.dot(F.col(vector), q), 5).alias("score"))
    return rows.orderBy(F.desc("score"), key).limit(k)


def rank_by_base(chunks: DataFrame, queries: DataFrame, k: int = 6, block: int = 20_000, ask: int = 4_000) -> DataFrame:
    """kb_id, query_id, chunk_id, score, rank: each query's best chunks of its base.

    ``chunks`` has kb_id, id and embedding; a query that is itself a chunk finds itself.
    """
    data = chunks.where("embedding is not null").select("kb_id", F.size("embedding").alias("dim"), F.col("id").alias("key"), F.col("embedding").alias("v"))
    asked = queries.where("query_vector is not null").select("kb_id", F.size("query_vector").alias("dim"), "query_id", F.col("query_vector").alias("v"))
    return _blockwise(data, asked, "kb_id", k, block, ask).withColumnRenamed("key", "chunk_id")


def batch_top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 6, block: int = 20_000, ask: int = 4_000) -> DataFrame:
    """query_id, key, score, rank: each query against all vectors of its length, exactly; null and empty vectors are left out."""
    data = vectors.where(F.size(vector) > 0).select(F.lit("").alias("_all"), F.size(vector).alias("dim"), F.col(key).alias("key"), F.col(vector).alias("v"))
    asked = queries.where(F.size("query_vector") > 0).select(F.lit("").alias("_all"), F.size("query_vector").alias("dim"), "query_id", F.col("query_vector").alias("v"))
    return _blockwise(data, asked, "_all", k, block, ask).drop("_all").withColumnRenamed("key", key)


def _blockwise(data: DataFrame, asked: DataFrame, part: str, k: int, block: int, ask: int) -> DataFrame:
    """``part``, query_id, key, score, rank: the k best rows of ``data`` for each of ``asked`` with the same part and vector length.

    Blocks of about ``block`` rows meet blocks of about ``ask`` queries; a pair of blocks is a
    task's group that multiplies matrices and gives at most k rows a query.
    """
    group = [part, "dim"]
    size = lambda rows, most, name: rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    n = size(data, block, "_n").join(size(asked, ask, "_m"), group)
    mine = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    data = data.join(n, group).withColumn("_b", mine("key", "_n")).withColumn("_q", each("_m")).select(*group, "_b", "_q", "key", "v")
    asked = asked.join(n, group).withColumn("_q", mine("query_id", "_m")).withColumn("_b", each("_n"))
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((data, part), (asked, "query_id"), (data, "key"))]

    def multiply(group: tuple, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = _best(q, d, k) if len(q) and len(d) else []
        return pd.DataFrame([(group[0], *r) for r in out], columns=[part, "query_id", "key", "score"])

    by = [*group, "_b", "_q"]
    left = ["_part", "_dim", "_block", "_ask"]
    asked = asked.select(*(F.col(c).alias(a) for c, a in zip(by, left)), "query_id", "v")
    rows = asked.groupBy(*left).cogroup(data.groupBy(*by)).applyInPandas(multiply, f"{part} {kinds[0]}, query_id {kinds[1]}, key {kinds[2]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return Stage(data.sparkSession, "ranked").put(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def _best(q: pd.DataFrame, d: pd.DataFrame, k: int) -> list[tuple]:
    """(query_id, key, score): the k best of ``d`` (key, v) for each of ``q`` (query_id, v), all of one length."""
    out = []
    m, keys = np.stack(d["v"].to_numpy()).astype(np.float64), d["key"].to_numpy()
    for start in range(0, len(q), 512):
        some = q.iloc[start : start + 512]
        s = np.round(np.stack(some["v"].to_numpy()).astype(np.float64) @ m.T, 5)
        low = np.where(np.isnan(s), -np.inf, -s)  # Spark holds NaN for the largest
        for i, query in enumerate(some["query_id"]):
            at = np.flatnonzero(low[i] <= np.partition(low[i], k - 1)[k - 1]) if len(keys) > k else range(len(keys))
            best = sorted((low[i][j], keys[j], s[i][j]) for j in at)[:k]
            out += [(query, key, score) for _, key, score in best]
    return out


def rerank(ranked: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """The candidates of ``rank_by_base`` again by the share of the query's words that they hold.

    A deterministic stand-in for a remote model; equal shares keep the vector order.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("query_text"), r"(?U)\W+"), lambda w: F.length(w) > 0))
    q = queries.select("query_id", words.alias("words"))
    rows = ranked.join(q, "query_id").join(chunks.select(F.col("id").alias("chunk_id"), F.lower("content").alias("_c")), "chunk_id")
    held = F.size(F.filter("words", lambda w: F.instr(F.col("_c"), w) > 0))
    rows = rows.withColumn("rerank_score", F.round(held / F.greatest(F.lit(1), F.size("words")), 5))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    rows = rows.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)
    return rows.select("kb_id", "query_id", "chunk_id", "score", "rerank_score", F.col("new_rank").alias("rank"))


def seed_entities(ranked: DataFrame, entity_chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, entity_id: entities of the base that stand in the ranked chunks."""
    e = entities.select(F.col("id").alias("entity_id"), F.col("kb_id").alias("_kb"))
    rows = ranked.select("kb_id", "query_id", "chunk_id").join(entity_chunks.select("entity_id", "chunk_id").distinct(), "chunk_id").join(e, "entity_id")
    return rows.where("kb_id = _kb").select("kb_id", "query_id", "entity_id").distinct()


def named_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, entity_id: entities of the base whose normalised name (two characters at least) stands in the query.

    Blocks of a base's texts meet blocks of its names; at each place of a text only names of the
    same first two characters are looked up, so the work is not texts times names.
    """
    q = queries.where("query_text is not null").select("kb_id", "query_id", F.lower("query_text").alias("text"))
    e = entities.select("kb_id", F.col("id").alias("entity_id"), T.normalize_name(F.coalesce("normalized_name", "name")).alias("name")).where("length(name) >= 2")
    nq, ne = (x.groupBy("kb_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(n)) for x, size, n in ((q, 2_000, "_nq"), (e, 100_000, "_ne")))
    n = nq.join(ne, "kb_id")
    mine, all_ = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(n, "kb_id").withColumn("_q", mine("query_id", "_nq")).withColumn("_e", all_("_ne"))
    e = e.join(n, "kb_id").withColumn("_e", mine("entity_id", "_ne")).withColumn("_q", all_("_nq"))

    def look(key: tuple, q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        ids: dict[str, list] = {}
        sizes: dict[str, set[int]] = {}
        for i, name in zip(e["entity_id"], e["name"]):
            ids.setdefault(name, []).append(i)
            sizes.setdefault(name[:2], set()).add(len(name))
        out = []
        for query, text in zip(q["query_id"], q["text"]):
            found = {text[at : at + size] for at in range(len(text) - 1) for size in sizes.get(text[at : at + 2], ())}
            out += [(key[0], query, i) for name in found for i in ids.get(name, ())]
        return pd.DataFrame(out, columns=["kb_id", "query_id", "entity_id"])

    kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (entities, "id"))]
    q = q.select(F.col("kb_id").alias("_kb"), F.col("_q").alias("_mine"), F.col("_e").alias("_other"), "query_id", "text")
    e = e.select("kb_id", "_q", "_e", "entity_id", "name")
    rows = q.groupBy("_kb", "_mine", "_other").cogroup(e.groupBy("kb_id", "_q", "_e")).applyInPandas(look, f"kb_id string, query_id {kinds[0]}, entity_id {kinds[1]}")
    return rows.distinct()


def local_facts(seeds: DataFrame, relations: DataFrame, entities: DataFrame, k: int = 16) -> DataFrame:
    """Each query's heaviest relations with a seed at either end; two semi-joins' union, not a disjunction."""
    r = clean_relations(relations).dropDuplicates(["id"])
    ends = [r.join(seeds.select("query_id", F.col("entity_id").alias(e)), e).select("query_id", "id") for e in ("source_id", "target_id")]
    hit = ends[0].union(ends[1]).distinct().join(r, "id")
    names = entities.select("id", "name")
    hit = hit.join(names.withColumnsRenamed({"id": "source_id", "name": "source"}), "source_id").join(names.withColumnsRenamed({"id": "target_id", "name": "target"}), "target_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "id")
    rows = hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", "id", "source_id", "target_id", "source", "target", "predicate", "description", "weight")


def related_chunks(seeds: DataFrame, facts: DataFrame, entity_chunks: DataFrame, k: int = 6) -> DataFrame:
    """query_id, chunk_id, relevance, rank: chunks by the mentions of the seeds and the facts' ends."""
    more = facts.select("query_id", F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    wide = seeds.select("query_id", "entity_id").union(more).distinct()
    rows = wide.join(mentions(entity_chunks), "entity_id").groupBy("query_id", "chunk_id").agg(F.sum("mention_count").alias("relevance"))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(ranked: DataFrame, related: DataFrame, k: int = 6) -> DataFrame:
    """Ranked chunks, then related ones not among them with score 0, k in all."""
    extra = related.join(ranked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    rows = ranked.select("query_id", "chunk_id", "score", F.lit(0).alias("_s"), "rank").unionByName(extra.select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(1).alias("_s"), "rank"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_s", "rank")))
    return rows.where(F.col("rank") <= k).drop("_s")


def local(queries: DataFrame, ranked: DataFrame, entities: DataFrame, entity_chunks: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, facts): entities of the ranked chunks or named in the query, and the relations around them."""
    stage = Stage(queries.sparkSession, "local")
    seeds = stage.put(seed_entities(ranked, entity_chunks, entities).union(named_entities(queries, entities)).distinct())
    return seeds, stage.put(local_facts(seeds, relations, entities))


def community_vectors(members: DataFrame, entity_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """kb_id, community, embedding: the unit mean of the vectors of all chunks that mention a member, one for each vector length.

    A chunk counts once in a community. Communities whose chunks have no vectors, or a mean
    without length, have no row.
    """
    told = members.select("kb_id", "community", "entity_id").join(entity_chunks.select("entity_id", "chunk_id"), "entity_id").select("kb_id", "community", "chunk_id").distinct()
    v = chunks.where("embedding is not null").select(F.col("id").alias("chunk_id"), F.size("embedding").alias("dim"), F.posexplode("embedding").alias("pos", "x"))
    key = ["kb_id", "community", "dim"]
    mean = told.join(v, "chunk_id").groupBy(*key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = mean.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("_v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"))
    return rows.where("_n > 0").select("kb_id", "community", F.transform("_v", lambda x: x / F.col("_n")).alias("embedding"))


def global_context(queries: DataFrame, communities: DataFrame, k: int = 4) -> DataFrame:
    """query_id, rank, community, title, summary, member_count, score: each query's most similar communities of its base.

    communities: kb_id, community, title, summary, member_count, embedding (null: left out).
    """
    found = rank_by_base(communities.select("kb_id", F.col("community").alias("id"), "embedding"), queries, k)
    told = communities.select("kb_id", F.col("community").alias("chunk_id"), "title", "summary", "member_count").distinct()
    return found.join(told, ["kb_id", "chunk_id"]).select("query_id", "rank", F.col("chunk_id").alias("community"), "title", "summary", "member_count", "score")


def search(mode: str, queries: DataFrame, chunks: DataFrame, entities: DataFrame, entity_chunks: DataFrame, relations: DataFrame, k: int = 6, communities: DataFrame | None = None) -> DataFrame:
    """The evidence of one mode: chunks for vector, graph_local (four vector seeds at most) and hybrid, communities for graph_global."""
    if mode == "graph_global":
        if communities is None:
            raise ValueError("graph_global needs communities")
        return global_context(queries, communities)
    if mode not in ("vector", "graph_local", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    ranked = rank_by_base(chunks, queries, k if mode != "graph_local" else min(4, k))
    if mode == "vector":
        return ranked.select("query_id", "chunk_id", "score", "rank")
    seeds, facts = local(queries, ranked, entities, entity_chunks, relations)
    return hybrid(ranked, related_chunks(seeds, facts, entity_chunks, k), k)


#: What stands for the evidence where there is none (fixed value).
NO_EVIDENCE = "（未检索到相关证据）"


def context(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, documents: DataFrame, facts: DataFrame | None = None, communities: DataFrame | None = None) -> DataFrame:
    """query_id, context: an answer's numbered evidence, sources first, then facts and communities, each in order of rank.

    There are few of each for a query. A query without any has NO_EVIDENCE.
    """
    d = documents.select(F.col("doc_id").alias("document_id"), "filename")
    rows = ranked.select("query_id", "chunk_id", "rank").join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_number", "content"), "chunk_id").join(d, "document_id")
    page = F.when(F.col("page_number") > 0, F.concat(F.lit("，第"), F.col("page_number").cast("string"), F.lit("页"))).otherwise("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("[来源"), text("rank"), F.lit("] 文件："), text("filename"), page, F.lit("\n"), text("content"))
    parts = rows.select("query_id", F.lit(0).alias("kind"), F.col("rank").cast("long").alias("rank"), line.alias("line"))
    if facts is not None:
        line = F.concat(F.lit("[图关系"), text("rank"), F.lit("] "), text("source"), F.lit(" —"), text("predicate"), F.lit("→ "), text("target"), F.lit("。"), text("description"))
        parts = parts.unionByName(facts.select("query_id", F.lit(1).alias("kind"), F.col("rank").cast("long").alias("rank"), line.alias("line")))
    if communities is not None:
        line = F.concat(F.lit("[图社区"), text("rank"), F.lit("] "), text("title"), F.lit("（"), text("member_count"), F.lit(" 个实体）\n"), text("summary"))
        parts = parts.unionByName(communities.select("query_id", F.lit(2).alias("kind"), F.col("rank").cast("long").alias("rank"), line.alias("line")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("kind", "rank", "line"))), lambda x: x["line"])
    told = parts.groupBy("query_id").agg(F.array_join(lines, "\n\n").alias("context"))
    return queries.select("query_id").join(told, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NO_EVIDENCE)).alias("context"))


def history(turns: DataFrame, last: int = 20, each: int = 6000, budget: int = 24_000) -> DataFrame:
    """conversation, turn, role, content: what of a conversation goes into the next prompt.

    The last turns, of users and assistants only, each cut to ``each`` characters; the newest
    fill the budget first and the one that crosses it is cut.
    """
    newest = Window.partitionBy("conversation").orderBy(F.desc("turn"))
    rows = turns.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last)
    rows = rows.where(F.col("role").isin("user", "assistant") & (F.length("content") > 0)).withColumn("_c", F.substring("content", 1, each))
    used = F.coalesce(F.sum(F.length("_c")).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_left", F.lit(budget) - used).where("_left > 0")
    return rows.select("conversation", "turn", "role", F.expr("substring(_c, 1, int(_left))").alias("content"))


def community_top_k(vectors: DataFrame, label: str, vector: str, query: list[float], k: int = 4) -> DataFrame:
    """label, members, score: groups by the inner product of their mean vector with the query."""
    dims = vectors.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    q = vectors.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(query)], "pos int, q double")
    score = dims.join(q, "pos").groupBy(label).agg(F.round(F.sum(F.col("x") * F.col("q")), 5).alias("score"))
    size = vectors.groupBy(label).agg(F.count(F.lit(1)).alias("members"))
    return score.join(size, label).orderBy(F.desc("score"), label).limit(k)
