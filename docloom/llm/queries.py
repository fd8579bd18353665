"""The pN_ queries and, where SQL can say the same over whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.tables import read

from . import abuse, groups, mixing, names, nearest, pieces, scans, tokens


def p1_found(spark, sf_dir):
    return names.variant_pairs(read(spark, sf_dir, "entities"))


def p1_clusters(spark, sf_dir):
    return names.clusters(read(spark, sf_dir, "entities"))


def p2_found(spark, sf_dir):
    return nearest.similar_pairs(read(spark, sf_dir, "chunks"))


def p2_neighbours(spark, sf_dir):
    return nearest.chunk_neighbours(read(spark, sf_dir, "chunks"))


def p3_found(spark, sf_dir):
    return groups.match_groups(read(spark, sf_dir, "matches"))


def p3_group_sizes(spark, sf_dir):
    found = groups.match_groups(read(spark, sf_dir, "matches"))
    return found.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.max("entity_id").alias("last_id"))


def p4_found(spark, sf_dir):
    return pieces.long_chunks(read(spark, sf_dir, "chunks"))


def p4_pieces(spark, sf_dir):
    return pieces.chunk_pieces(read(spark, sf_dir, "chunks"))


def p4_document_pieces(spark, sf_dir):
    return pieces.document_pieces(read(spark, sf_dir, "documents"))


def p4_file_pieces(spark, sf_dir):
    return pieces.file_pieces(read(spark, sf_dir, "documents"))


def p5_found(spark, sf_dir):
    return scans.defects(read(spark, sf_dir, "chunks"))


def p5_text(spark, sf_dir):
    return scans.repaired(read(spark, sf_dir, "chunks"))


def p6_ids(spark, sf_dir):
    return tokens.encode(read(spark, sf_dir, "documents"), "doc_id", "text")


def p7_chosen(spark, sf_dir):
    return mixing.document_mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))


def p7_shares(spark, sf_dir):
    return mixing.mix_shares(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))


def p8_found(spark, sf_dir):
    return abuse.abusive_documents(read(spark, sf_dir, "documents"))


def p8_scores(spark, sf_dir):
    return abuse.scored(read(spark, sf_dir, "documents"))


def p8_rates(spark, sf_dir):
    return abuse.source_rates(read(spark, sf_dir, "documents"))


_P3 = """
with recursive e as (
  select distinct left_id a, right_id b from matches where same_entity and left_id <> right_id
  union select distinct right_id, left_id from matches where same_entity and left_id <> right_id),
reach(a, b) as (select a, a from e union select r.a, e.b from reach r join e on e.a = r.b),
g as (select a as entity_id, min(b) as group_id from reach group by a)
"""

QUERIES = {q.__name__: q for q in (p1_found, p1_clusters, p2_found, p2_neighbours, p3_found, p3_group_sizes, p4_found, p4_pieces, p4_document_pieces, p4_file_pieces, p5_found, p5_text, p6_ids, p7_chosen, p7_shares, p8_found, p8_scores, p8_rates)}

_P4 = r"""
select id as chunk_id from chunks
where length(trim(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(10))) > 900
"""

SQL = {
    "p4_found": _P4,
    "p3_found": _P3 + "select entity_id, group_id from g",
    "p3_group_sizes": _P3 + "select group_id, count(*) as members, max(entity_id) as last_id from g group by group_id",
}
