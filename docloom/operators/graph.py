"""The knowledge graph as reductions over logs of extracted entities and relations."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.tables import Stage

from .components import components

DEFAULT_TYPE, DEFAULT_PREDICATE = "概念", "相关"
LPA_PASSES = 12
#: Components with more edges than this are labelled by joins instead of in one task. Both ways make the same
#: updates in the same order, so this bounds a task's memory and changes no label.
LPA_TASK_EDGES = 200_000


def entity_upsert(log: DataFrame) -> DataFrame:
    """kb_id, normalized_name, id, name, entity_type, description, rows: one row per name of a base.

    First arrival gives id and name; the type is the first that is not the default; the
    longest description wins, the first of equals. Arrival is (created_at, id). Rows without
    a name are dropped; a null type is the default, a null description empty.
    """
    rows = log.withColumn("normalized_name", T.normalize_name(F.col("name"))).where(F.length("normalized_name") > 0)
    rows = rows.withColumn("entity_type", F.coalesce("entity_type", F.lit(DEFAULT_TYPE))).withColumn("description", F.coalesce("description", F.lit("")))
    ord_ = F.struct("created_at", "id")
    typed = F.min_by(F.when(F.col("entity_type") != DEFAULT_TYPE, F.col("entity_type")), F.when(F.col("entity_type") != DEFAULT_TYPE, ord_))
    return rows.groupBy("kb_id", "normalized_name").agg(
        F.min_by("id", ord_).alias("id"), F.min_by("name", ord_).alias("name"), F.coalesce(typed, F.lit(DEFAULT_TYPE)).alias("entity_type"),
        F.min_by("description", F.struct(-F.length("description"), F.col("created_at"), F.col("id"))).alias("description"), F.count(F.lit(1)).alias("rows"),
    )


def clean_relations(log: DataFrame) -> DataFrame:
    """Relations with both ends, no self-relations, weights clamped and null predicates by the default."""
    p = F.trim(F.col("predicate"))
    rows = log.where("source_id is not null and target_id is not null and source_id <> target_id")
    rows = rows.withColumn("predicate", F.coalesce(F.when(F.length(p) > 0, p), F.lit(DEFAULT_PREDICATE)))
    return rows.withColumn("weight", T.clamp_weight(F.col("weight"))).withColumn("description", F.coalesce("description", F.lit("")))


def relation_upsert(log: DataFrame) -> DataFrame:
    """One row per (kb, source, target, predicate): largest weight, longest description, first id and evidence."""
    ord_ = F.struct("created_at", "id")
    return clean_relations(log).groupBy("kb_id", "source_id", "target_id", "predicate").agg(
        F.min_by("id", ord_).alias("id"), F.max("weight").alias("weight"),
        F.min_by("description", F.struct(-F.length("description"), F.col("created_at"), F.col("id"))).alias("description"),
        F.min_by(F.struct("evidence_chunk_id"), ord_)["evidence_chunk_id"].alias("evidence_chunk_id"), F.count(F.lit(1)).alias("rows"),
    )


def mentions(entity_chunks: DataFrame) -> DataFrame:
    """entity_id, chunk_id, mention_count: repeated rows are replays, the largest count stands."""
    return entity_chunks.groupBy("entity_id", "chunk_id").agg(F.max("mention_count").alias("mention_count"))


def entity_mentions(entities: DataFrame, entity_chunks: DataFrame) -> DataFrame:
    """Entities with source_chunks and mention_count; counted before the join."""
    m = mentions(entity_chunks).groupBy("entity_id").agg(F.count(F.lit(1)).alias("source_chunks"), F.sum("mention_count").alias("mention_count"))
    return entities.join(m, entities["id"] == m["entity_id"], "left").drop("entity_id").fillna(0, ["source_chunks", "mention_count"])


def missing_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """kb_id, entity_id: ends of relations that no entity row has (an anti-join)."""
    ends = relations.select("kb_id", F.col("source_id").alias("entity_id")).union(relations.select("kb_id", "target_id")).where("entity_id is not null").distinct()
    return ends.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select("kb_id", "entity_id")


def match_quality(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """Asked pairs with the likeness of their names and whether their types allow one entity.

    pair_id, ratio (of the normalised names), compatible, candidate: like enough or contained.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else None for x, y in zip(a, b)])

    e = entities.select("id", T.normalize_name(F.col("name")).alias("n"), F.coalesce("entity_type", F.lit("")).alias("t"))
    left = e.select(F.col("id").alias("left_id"), F.col("n").alias("ln"), F.col("t").alias("lt"))
    right = e.select(F.col("id").alias("right_id"), F.col("n").alias("rn"), F.col("t").alias("rt"))
    rows = matches.join(left, "left_id").join(right, "right_id").where("ln <> rn")
    open_ = F.array(F.lit(DEFAULT_TYPE), F.lit("其他"), F.lit(""))
    rows = rows.withColumn("compatible", (F.col("lt") == F.col("rt")) | F.array_contains(open_, F.col("lt")) | F.array_contains(open_, F.col("rt")))
    rows = rows.withColumn("name_ratio", F.round(ratio("ln", "rn"), 5))
    short = F.least(F.length("ln"), F.length("rn"))
    contained = (short >= 4) & ((F.instr(F.col("ln"), F.col("rn")) > 0) | (F.instr(F.col("rn"), F.col("ln")) > 0)) & (F.col("name_ratio") >= 0.55)
    return rows.select("pair_id", "name_ratio", "compatible", (F.col("compatible") & ((F.col("name_ratio") >= 0.72) | contained)).alias("candidate"))


def alias_map(matches: DataFrame, entities: DataFrame, entity_chunks: DataFrame) -> DataFrame:
    """entity_id, canonical_id for every entity of a group of matched ones.

    Canonical is the member with most votes, then mentions, the longer description, the
    shorter name, the larger id.
    """
    yes = matches.where("same_entity and left_id is not null and right_id is not null and left_id <> right_id")
    votes = yes.select(F.when(F.col("canonical") == "left", F.col("left_id")).when(F.col("canonical") == "right", F.col("right_id")).alias("node")).where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("votes"))
    e = entity_mentions(entities, entity_chunks).select(F.col("id").alias("node"), "mention_count", F.length(F.coalesce("description", F.lit(""))).alias("_d"), F.length(F.coalesce("name", F.lit(""))).alias("_n"))
    rows = components(yes, "left_id", "right_id").join(e, "node").join(votes, "node", "left").fillna(0, ["votes"])
    best = F.max_by("node", F.struct("votes", "mention_count", "_d", -F.col("_n"), "node"))
    canon = rows.groupBy("component").agg(best.alias("canonical_id"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    return rows.join(canon, "component").select(F.col("node").alias("entity_id"), "canonical_id")


def merge_relations(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Relations with merged ends, self-loops dropped, reduced anew."""
    rows = clean_relations(relations)
    for end in ("source_id", "target_id"):
        a = aliases.select(F.col("entity_id").alias(end), F.col("canonical_id").alias("_to"))
        rows = rows.join(a, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return relation_upsert(rows)


def merge_mentions(entity_chunks: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions of merged entities added up per chunk."""
    rows = mentions(entity_chunks).join(aliases, "entity_id", "left").withColumn("entity_id", F.coalesce("canonical_id", "entity_id"))
    return rows.groupBy("entity_id", "chunk_id").agg(F.sum("mention_count").alias("mention_count"))


def adjacency(relations: DataFrame) -> DataFrame:
    """kb_id, node, neighbour, weight: relations as undirected edges, weights added up."""
    r = clean_relations(relations).select("kb_id", "source_id", "target_id", "weight")
    there = r.select("kb_id", F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), "weight")
    back = r.select("kb_id", F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), "weight")
    return there.unionByName(back).groupBy("kb_id", "node", "neighbour").agg(F.sum("weight").alias("weight"))


def degrees(relations: DataFrame) -> DataFrame:
    """kb_id, entity_id, degree: ends of relations per entity."""
    ends = relations.select("kb_id", F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    return ends.where("entity_id is not null").groupBy("kb_id", "entity_id").agg(F.count(F.lit(1)).alias("degree"))


def _propagate(edges: pd.DataFrame) -> pd.DataFrame:
    """One component's labels: nodes by falling degree take their neighbours' heaviest label, in place."""
    around: dict[str, list[tuple[str, float]]] = {}
    for node, neighbour, weight in sorted(zip(edges["node"], edges["neighbour"], edges["weight"])):
        around.setdefault(node, []).append((neighbour, weight))
    label = {n: n for n in around}
    order = sorted(around, key=lambda n: (-len(around[n]), n))
    for _ in range(LPA_PASSES):
        before = dict(label)
        for n in order:
            heard: dict[str, float] = {}
            for m, w in around[n]:
                heard[label[m]] = heard.get(label[m], 0.0) + w
            top = max(heard.values())
            label[n] = min(x for x, w in heard.items() if w == top)
        if label == before:
            break
    return pd.DataFrame({"kb_id": edges["kb_id"].iloc[0], "entity_id": list(label), "community": list(label.values())})


def communities(relations: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """kb_id, entity_id, community (a member's id) by label propagation.

    With ``entities`` those without a relation are there too, each a community of its own. The
    update order matters only inside a connected component, so components are the unit of work.
    Those too large for a task (LPA_TASK_EDGES) take the same updates level by level.
    """
    stage = Stage(relations.sparkSession, "communities")
    adj = stage.put(adjacency(relations))
    parts = stage.put(components(adj.where("node < neighbour"), "node", "neighbour"))
    size = adj.join(parts, "node").groupBy("component").agg(F.count(F.lit(1)).alias("_edges"))
    rows = adj.join(parts.join(size, "component"), "node")
    out = rows.where(F.col("_edges") <= LPA_TASK_EDGES).groupBy("kb_id", "component").applyInPandas(_propagate, "kb_id string, entity_id string, community string")
    if not size.where(F.col("_edges") > LPA_TASK_EDGES).isEmpty():
        large = rows.where(F.col("_edges") > LPA_TASK_EDGES).select("kb_id", "node", "neighbour", "weight")
        out = out.unionByName(levelled_labels(large))
    if entities is not None:
        alone = entities.select("kb_id", F.col("id").alias("entity_id")).distinct().join(parts.select(F.col("node").alias("entity_id")), "entity_id", "left_anti")
        out = out.unionByName(alone.select("kb_id", "entity_id", F.col("entity_id").alias("community")))
    return out


def levelled_labels(adj: DataFrame, passes: int = LPA_PASSES) -> DataFrame:
    """The labels of ``_propagate`` by joins, for components of any size.

    An update in place needs the new labels of the neighbours that come earlier in (-degree, id)
    and the old ones of the others. A node's level is one more than the highest of its earlier
    neighbours, so the nodes of a level don't need each other and are updated at once. Weights
    are added in the order of the neighbours, as doubles depend on it; a node's neighbours of
    one label are gathered for that.
    """
    spark, key = adj.sparkSession, ["kb_id", "node"]
    stage = Stage(spark, "levels")
    adj = stage.put(adj.select(*key, "neighbour", "weight"))
    degree = stage.put(adj.groupBy(*key).agg(F.count(F.lit(1)).alias("degree")))
    other = degree.select("kb_id", F.col("node").alias("neighbour"), F.col("degree").alias("_d"))
    first = (F.col("_d") > F.col("degree")) | ((F.col("_d") == F.col("degree")) & (F.col("neighbour") < F.col("node")))
    earlier = stage.put(adj.select(*key, "neighbour").join(degree, key).join(other, ["kb_id", "neighbour"]).where(first).select(*key, "neighbour"))
    waits = earlier.groupBy(*key).agg(F.count(F.lit(1)).alias("wait"))
    left = stage.put(degree.join(waits, key, "left").select(*key, F.coalesce("wait", F.lit(0)).alias("wait")))
    edges, labels = [], []
    while not left.isEmpty():
        ready = left.where("wait = 0").select(*key)
        edges.append(stage.put(adj.join(ready, key)))
        labels.append(stage.put(ready.withColumn("label", F.col("node"))))
        done = earlier.join(ready.withColumnRenamed("node", "neighbour"), ["kb_id", "neighbour"]).groupBy(*key).agg(F.count(F.lit(1)).alias("_done"))
        rest = stage.put(left.where("wait > 0").join(done, key, "left").select(*key, (F.col("wait") - F.coalesce("_done", F.lit(0))).alias("wait")))
        stage.drop(left)
        left = rest

    def now() -> DataFrame:
        return spark.read.schema(labels[0].schema).parquet(*(x._stage_path for x in labels))

    if not labels:
        return adj.select("kb_id", F.col("node").alias("entity_id"), F.col("node").alias("community"))
    mark = None
    for _ in range(passes):
        for i, mine in enumerate(edges):
            told = mine.join(now().withColumnRenamed("node", "neighbour"), ["kb_id", "neighbour"])
            weights = F.sort_array(F.collect_list(F.struct("neighbour", "weight")))
            heard = told.groupBy(*key, "label").agg(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x["weight"]).alias("w"))
            new = stage.put(heard.groupBy(*key).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("label")))
            stage.drop(labels[i])
            labels[i] = new
        last, mark = mark, now().agg(F.count(F.lit(1)), F.sum(F.xxhash64("kb_id", "node", "label").cast("decimal(38,0)"))).first()
        if mark == last:
            break
    return now().select("kb_id", F.col("node").alias("entity_id"), F.col("label").alias("community"))


def synchronous_labels(adj: DataFrame, passes: int = LPA_PASSES) -> DataFrame:
    """Label propagation in rounds that all nodes take at once: another algorithm, which `communities` doesn't use."""
    stage = Stage(adj.sparkSession, "labels")
    adj = stage.put(adj)
    labels = stage.put(adj.select("kb_id", "node").distinct().withColumn("label", F.col("node")))
    for _ in range(passes):
        told = adj.join(labels.select("kb_id", F.col("node").alias("neighbour"), "label"), ["kb_id", "neighbour"])
        heard = told.groupBy("kb_id", "node", "label").agg(F.sum("weight").alias("w"))
        best = heard.groupBy("kb_id", "node").agg(F.max("w").alias("w")).join(heard, ["kb_id", "node", "w"]).groupBy("kb_id", "node").agg(F.min("label").alias("label"))
        new = stage.put(best)
        changed = new.exceptAll(labels).isEmpty()
        labels = new
        if changed:
            break
    return labels.select("kb_id", F.col("node").alias("entity_id"), F.col("label").alias("community"))


def community_ids(members: DataFrame, entities: DataFrame) -> DataFrame:
    """kb_id, community_id, community, member_count: the id is a hash of the members' ids, names and types.

    Members are hashed one by one and their hashes added up, which no order changes and which is
    combined before the shuffle, so a community of any size is one small row.
    """
    e = entities.select(F.col("id").alias("entity_id"), F.concat_ws("\x1f", "id", F.coalesce("name", F.lit("")), F.coalesce("entity_type", F.lit(""))).alias("_s"))
    digest = F.sha2("_s", 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    out = members.join(e, "entity_id").groupBy("kb_id", "community").agg(part(0).alias("_a"), part(1).alias("_b"), part(2).alias("_c"), F.count(F.lit(1)).alias("member_count"))
    mark = F.sha2(F.concat_ws("-", "_a", "_b", "_c", F.col("member_count").cast("string")), 256)
    name = F.concat(F.lit("community-"), F.substring("kb_id", 1, 8), F.lit("-"), F.substring(mark, 1, 24))
    return out.select("kb_id", name.alias("community_id"), "community", "member_count")


def upkeep(before: DataFrame, now: DataFrame) -> DataFrame:
    """kb_id, community_id, state of communities named by their content.

    ``kept`` ones keep their summary and vector, ``new`` ones need both, ``stale`` ones are to be removed.
    """
    b, n = (x.select("kb_id", "community_id", F.lit(True).alias(c)) for x, c in ((before, "_b"), (now, "_n")))
    rows = b.join(n, ["kb_id", "community_id"], "full")
    return rows.select("kb_id", "community_id", F.when(F.col("_n").isNull(), "stale").when(F.col("_b").isNull(), "new").otherwise("kept").alias("state"))


def described(members: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """kb_id, community, title, summary, member_count (its entities)."""
    e = entities.select(F.col("id").alias("entity_id"))
    size = members.join(e, "entity_id").groupBy("kb_id", "community").agg(F.count(F.lit(1)).alias("member_count"))
    return size.join(fallback_summaries(members, entities, relations), ["kb_id", "community"])


def by_size(members: DataFrame, most: int = 100) -> DataFrame:
    """kb_id, rank, community, member_count, first_member: a base's ``most`` largest communities, equal ones by their smallest member."""
    size = members.groupBy("kb_id", "community").agg(F.count(F.lit(1)).alias("member_count"), F.min("entity_id").alias("first_member"))
    order = Window.partitionBy("kb_id").orderBy(F.desc("member_count"), "first_member")
    return size.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("kb_id", "rank", "community", "member_count", "first_member")


def members(communities: DataFrame, entities: DataFrame) -> DataFrame:
    """kb_id, community, id, name, entity_type: one row per member that is an entity of the base."""
    e = entities.select("kb_id", F.col("id").alias("entity_id"), "name", F.coalesce("entity_type", F.lit(DEFAULT_TYPE)).alias("entity_type"))
    return communities.join(e, ["kb_id", "entity_id"]).select("kb_id", "community", F.col("entity_id").alias("id"), "name", "entity_type")


def internal_relations(members: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose both ends lie in one community, with it."""
    s = members.select(F.col("entity_id").alias("source_id"), F.col("community").alias("_a"))
    t = members.select(F.col("entity_id").alias("target_id"), F.col("community").alias("_b"))
    rows = relation_upsert(relations).join(s, "source_id").join(t, "target_id").where("_a = _b")
    return rows.select("kb_id", F.col("_a").alias("community"), "id", "source_id", "target_id", "predicate", "weight", "description")


def fallback_summaries(members: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """kb_id, community, title (first three names), summary (first six relations, else entities).

    Members stand in order of name and id, relations of weight, predicate and id. Ranks are
    taken first, so at most six lines of a community are gathered.
    """
    e = entities.select(F.col("id").alias("entity_id"), "name", F.coalesce("entity_type", F.lit(DEFAULT_TYPE)).alias("entity_type"), F.coalesce("description", F.lit("")).alias("description"))
    m = members.join(e, "entity_id").withColumn("_r", F.row_number().over(Window.partitionBy("kb_id", "community").orderBy("name", "entity_id"))).where("_r <= 6")
    line = F.concat(F.lit("- "), "name", F.lit("（"), "entity_type", F.lit("）："), "description")
    m = m.groupBy("kb_id", "community").agg(_first("_r", "name", 3, "、").alias("title"), _first("_r", line, 6, "；").alias("_entities"))
    names = e.select("entity_id", "name")
    r = internal_relations(members, relations).withColumn("_r", F.row_number().over(Window.partitionBy("kb_id", "community").orderBy(F.desc("weight"), "predicate", "id"))).where("_r <= 6")
    r = r.join(names.withColumnsRenamed({"entity_id": "source_id", "name": "_s"}), "source_id").join(names.withColumnsRenamed({"entity_id": "target_id", "name": "_t"}), "target_id")
    told = F.concat(F.lit("- "), "_s", F.lit(" —"), "predicate", F.lit("→ "), "_t", F.lit("："), "description")
    r = r.groupBy("kb_id", "community").agg(_first("_r", told, 6, "；").alias("_relations"))
    rows = m.join(r, ["kb_id", "community"], "left")
    return rows.select("kb_id", "community", F.substring("title", 1, 80).alias("title"), F.substring(F.coalesce("_relations", "_entities"), 1, 2000).alias("summary"))


def _first(rank: str, value, n: int, sep: str):
    value = F.col(value) if isinstance(value, str) else value
    lines = F.sort_array(F.collect_list(F.when(F.col(rank) <= n, F.struct(F.col(rank).alias("r"), value.alias("v")))))
    return F.array_join(F.transform(lines, lambda x: x["v"]), sep)


def page(entities: DataFrame, entity_chunks: DataFrame, relations: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each base's view: its most mentioned entities and the relations among them."""
    limit = max(20, min(1000, limit))
    order = Window.partitionBy("kb_id").orderBy(F.desc("mention_count"), "name", "id")
    nodes = entity_mentions(entities, entity_chunks).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    ids = nodes.select("id")
    edges = relation_upsert(relations).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes.select("kb_id", "id", "name", "entity_type", "mention_count", "rank"), edges


def important(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes whose labels are shown: top min(24, max(10, ceil(3 sqrt n))) by 4 degree + mentions."""
    d = degrees(edges).select(F.col("entity_id").alias("id"), "degree")
    rows = nodes.join(d, "id", "left").fillna(0, ["degree"]).withColumn("score", 4 * F.col("degree") + F.col("mention_count"))
    n = F.count(F.lit(1)).over(Window.partitionBy("kb_id"))
    rows = rows.withColumn("_top", F.least(F.lit(24), F.greatest(F.lit(10), F.ceil(3 * F.sqrt(n)))))
    rows = rows.withColumn("label_rank", F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("score"), "name", "id")))
    return rows.where("label_rank <= _top").select("kb_id", "id", "name", "score", "label_rank")


def parallel_edges(relations: DataFrame) -> DataFrame:
    """Relations between one pair of entities, numbered by predicate and id, with their number."""
    pair = [F.col("kb_id"), F.least("source_id", "target_id"), F.greatest("source_id", "target_id")]
    rows = relation_upsert(relations).withColumn("parallel_rank", F.row_number().over(Window.partitionBy(*pair).orderBy("predicate", "id")))
    return rows.withColumn("parallel_count", F.count(F.lit(1)).over(Window.partitionBy(*pair))).select("kb_id", "id", "parallel_rank", "parallel_count")


def neighbourhood(relations: DataFrame, centres: DataFrame) -> DataFrame:
    """kb_id, centre, neighbour: one step from each centre (kb_id, centre), either way."""
    adj = adjacency(relations).select("node", "neighbour")
    return centres.join(adj, centres["centre"] == adj["node"]).select("kb_id", "centre", "neighbour").distinct()
