"""Datasets as lines of text formats, made by expressions and written in parallel.

Every function gives (order, line) or (key, line) rows; ``write`` puts them to text files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Colours of node types (fixed values).
PALETTE = ["#477ae8", "#df6c42", "#87a91c", "#8c61c9", "#299d8f", "#c65c8b", "#69736d"]


def markdown_rows(df: DataFrame, columns: list[str]) -> Column:
    """A row of a Markdown table."""
    cells = [T.markdown_cell(F.col(c)) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def xml(c: Column) -> Column:
    """Text escaped for XML."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(sign), F.lit(name))
    return t


def _frame(rows: DataFrame, **texts: str) -> DataFrame:
    """``rows`` (kb_id, part, rank, id, line) with one more line in each base for each ``partN=text``."""
    bases = rows.select("kb_id").distinct()
    for part, text in texts.items():
        rows = rows.unionByName(bases.select("kb_id", F.lit(int(part[4:])).alias("part"), F.lit(0).cast("long").alias("rank"), F.lit("").alias("id"), F.lit(text).alias("line")))
    return rows


def _lines(df: DataFrame, part: int, line: Column, rank: Column | None = None) -> DataFrame:
    return df.select("kb_id", F.lit(part).alias("part"), (F.lit(0) if rank is None else rank).cast("long").alias("rank"), "id", line.alias("line"))


# fixed values: the frames of GraphML and GEXF documents
_GRAPHML = """<?xml version="1.0" encoding="utf-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="name" for="node" attr.name="name" attr.type="string"/>
<key id="type" for="node" attr.name="type" attr.type="string"/>
<key id="description" for="all" attr.name="description" attr.type="string"/>
<key id="predicate" for="edge" attr.name="predicate" attr.type="string"/>
<key id="weight" for="edge" attr.name="weight" attr.type="double"/>
<graph edgedefault="directed">"""
_GEXF = """<?xml version="1.0" encoding="utf-8"?>
<gexf xmlns="http://www.gexf.net/1.3" version="1.3">
<graph mode="static" defaultedgetype="directed">
<nodes>"""


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kb_id, part, rank, id, line of a directed GraphML document for each base: 0 head, 1 nodes, 2 edges, 3 end."""
    data = lambda key: F.concat(F.lit(f'<data key="{key}">'), xml(F.col({"type": "entity_type"}.get(key, key))), F.lit("</data>"))
    n = F.concat(F.lit('<node id="'), xml(F.col("id")), F.lit('">'), data("name"), data("type"), data("description"), F.lit("</node>"))
    e = F.concat(
        F.lit('<edge id="'), xml(F.col("id")), F.lit('" source="'), F.col("source_id"), F.lit('" target="'), F.col("target_id"), F.lit('">'),
        data("predicate"), data("description"), data("weight"), F.lit("</edge>"),
    )
    return _frame(_lines(nodes, 1, n).unionByName(_lines(edges, 2, e)), part0=_GRAPHML, part3="</graph>\n</graphml>")


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kb_id, part, rank, id, line of a GEXF 1.3 document for each base: 0 head, 1 nodes, 2 between, 3 edges, 4 end."""
    n = F.concat(F.lit('<node id="'), xml(F.col("id")), F.lit('" label="'), xml(F.col("name")), F.lit('"/>'))
    e = F.concat(
        F.lit('<edge id="'), xml(F.col("id")), F.lit('" source="'), F.col("source_id"), F.lit('" target="'), F.col("target_id"),
        F.lit('" label="'), xml(F.col("predicate")), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>'),
    )
    return _frame(_lines(nodes, 1, n).unionByName(_lines(edges, 3, e)), part0=_GEXF, part2="</nodes>\n<edges>", part4="</edges>\n</graph>\n</gexf>")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kb_id, part, rank, id, line of one JSON object {nodes, edges} for each base; an item's line begins with the comma before it."""

    def items(df: DataFrame, part: int, columns: list[str]) -> DataFrame:
        first = df.groupBy("kb_id").agg(F.min("id").alias("_first"))
        rows = df.join(first, "kb_id")
        return _lines(rows, part, F.concat(F.when(F.col("id") == F.col("_first"), "").otherwise(","), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))

    n = items(nodes, 1, ["id", "name", "entity_type", "description"])
    e = items(edges, 3, ["id", "source_id", "target_id", "predicate", "description", "weight"])
    return _frame(n.unionByName(e), part0='{"nodes": [', part2='], "edges": [', part4="]}")


def graph_markdown(bases: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 80, most: int = 160) -> DataFrame:
    """kb_id, part, rank, id, line of a Markdown document for each base (kb_id, title): sizes, a chart, then all nodes and edges.

    nodes have a mention_count. The chart shows the ``top`` most mentioned nodes and the ``most``
    heaviest edges among them.
    """
    order = Window.partitionBy("kb_id").orderBy(F.desc("mention_count"), "name", "id")
    some = nodes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sizes = [df.groupBy("kb_id").agg(F.count(F.lit(1)).alias(n)) for df, n in ((nodes, "_n"), (edges, "_e"))]
    head = bases.join(sizes[0], "kb_id").join(sizes[1], "kb_id", "left").fillna(0, ["_e"])
    text = F.format_string("# %s · 知识图谱\n\n- 实体：%d\n- 关系：%d\n\n## Mermaid 预览\n\n```mermaid\nflowchart LR", F.coalesce("title", F.lit("")), "_n", "_e")
    out = [_lines(head.withColumn("id", F.lit("")), 0, text)]
    out += [_lines(x, x_part, line, F.col("rank")) for x, x_part, line in _chart(some, edges, most)]
    blank = lambda c: F.when(F.length(c) > 0, F.col(c)).otherwise("—")
    named = nodes.select("id", "name")
    ends = edges.join(named.withColumnsRenamed({"id": "source_id", "name": "_s"}), "source_id").join(named.withColumnsRenamed({"id": "target_id", "name": "_t"}), "target_id")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out.append(_lines(nodes, 4, F.concat(F.lit("- **"), shown("name"), F.lit("**（"), shown("entity_type"), F.lit("）："), blank("description")), -F.col("mention_count")))
    line = F.concat(F.lit("- **"), shown("_s"), F.lit("** —"), shown("predicate"), F.lit("→ **"), shown("_t"), F.lit("**（权重 "), shown("weight"), F.lit("）："), blank("description"))
    out.append(_lines(ends, 6, line))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return _frame(rows, part3="```\n\n## 实体\n", part5="\n## 关系\n")


def _chart(some: DataFrame, edges: DataFrame, most: int) -> list[tuple[DataFrame, int, Column]]:
    """(rows, part, line) of a flow chart's nodes and of its heaviest edges."""
    label = F.replace(F.replace(F.coalesce("name", F.lit("")), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    n = F.concat(F.lit("  n"), (F.col("rank") - 1).cast("string"), F.lit('["'), label, F.lit('"]'))
    at = some.select("id", (F.col("rank") - 1).cast("string").alias("n"))
    e = edges.join(at.withColumnsRenamed({"id": "source_id", "n": "s"}), "source_id").join(at.withColumnsRenamed({"id": "target_id", "n": "t"}), "target_id")
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("weight"), "id"))).where(F.col("rank") <= most)
    said = F.replace(F.replace(F.col("predicate"), F.lit("|"), F.lit("/")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("  n"), "s", F.lit(" -->|"), said, F.lit("| n"), "t")
    return [(some, 1, n), (e, 2, line)]


def mermaid(nodes: DataFrame, edges: DataFrame, top: int = 80, most: int = 160) -> DataFrame:
    """kb_id, part, rank, id, line: a flow chart of the first ``top`` ranked nodes and ``most`` edges among them."""
    (n, i, line), (e, j, more) = _chart(nodes.where(F.col("rank") <= top), edges, most)
    return _lines(n, i, line, F.col("rank")).unionByName(_lines(e, j, more, F.col("rank")))


def layout(nodes: DataFrame, width: int = 2400, height: int = 1600) -> DataFrame:
    """Nodes with x and y on a spiral by rank: equal areas, golden angle."""
    n = F.count(F.lit(1)).over(Window.partitionBy("kb_id"))
    i = F.col("rank") - 1
    r = F.when(n <= 1, F.lit(0.0)).otherwise(50 + F.sqrt(i / F.greatest(F.lit(1), n - 1)) * (min(width, height) * 0.44 - 50))
    angle = i * F.lit(math.pi * (3 - math.sqrt(5)))
    return nodes.withColumn("x", F.lit(width / 2) + F.cos(angle) * r).withColumn("y", F.lit(height / 2) + F.sin(angle) * r)


def colour(c: Column) -> Column:
    """A type's colour: the sum of its code points picks one."""
    t = F.coalesce(c, F.lit(""))
    points = F.transform(F.split(t, ""), lambda x: F.when(F.length(x) > 0, F.ascii(x)).otherwise(0))
    total = F.aggregate(points, F.lit(0), lambda s, x: s + x.cast("int"))
    return F.element_at(F.array(*map(F.lit, PALETTE)), F.pmod(total, F.lit(len(PALETTE))) + 1)


# fixed values: the frame of a picture
_SVG = """<svg xmlns="http://www.w3.org/2000/svg" width="2400" height="1600" viewBox="0 0 2400 1600">
<defs><marker id="arrow" viewBox="0 0 10 10" refX="8" refY="5" markerWidth="5" markerHeight="5" orient="auto-start-reverse"><path d="M 0 0 L 10 5 L 0 10 z" fill="#7b8781"/></marker></defs>
<rect width="100%" height="100%" fill="#f3f1e8"/>
<g stroke="#7b8781" stroke-opacity=".28" stroke-width="1.2" marker-end="url(#arrow)">"""


def svg(nodes: DataFrame, edges: DataFrame, labels: int = 50) -> DataFrame:
    """kb_id, part, rank, id, line of a picture of each page: 0 head, 1 edges, 2 between, 3 nodes, 4 the names of the ``labels`` best connected nodes, 5 end."""
    placed = layout(nodes)
    at = placed.select("id", "x", "y")
    ends = edges.join(at.withColumnsRenamed({"id": "source_id", "x": "x1", "y": "y1"}), "source_id").join(at.withColumnsRenamed({"id": "target_id", "x": "x2", "y": "y2"}), "target_id")
    e = F.format_string('<line x1="%.1f" y1="%.1f" x2="%.1f" y2="%.1f"/>', "x1", "y1", "x2", "y2")
    degree = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    p = placed.join(degree, "id", "left").fillna(0, ["degree"]).withColumn("_r", 8 + F.least(F.lit(12.0), F.sqrt("degree") * 2))
    n = F.concat(F.format_string('<circle cx="%.1f" cy="%.1f" r="%.1f" fill="', "x", "y", "_r"), colour(F.col("entity_type")), F.lit('" stroke="#fff" stroke-width="2"><title>'), xml(F.col("name")), F.lit("</title></circle>"))
    top = p.withColumn("_top", F.row_number().over(Window.partitionBy("kb_id").orderBy(F.desc("degree"), "rank"))).where(F.col("_top") <= labels)
    t = F.concat(F.format_string('<text x="%.1f" y="%.1f" font-family="system-ui,sans-serif" font-size="12" fill="#25322d">', F.col("x") + F.col("_r") + 5, F.col("y") + 4), xml(F.substring("name", 1, 40)), F.lit("</text>"))
    rows = _lines(ends, 1, e).unionByName(_lines(p, 3, n)).unionByName(_lines(top, 4, t))
    return _frame(rows, part0=_SVG, part2="</g><g>", part5="</g>\n</svg>")


def vector_text(c: Column) -> Column:
    """Numbers with eight digits, separated by spaces."""
    return F.array_join(F.transform(c, lambda x: F.format_string("%.8e", x.cast("double"))), " ")


def write(lines: DataFrame, path: str, order: tuple[str, ...] = ("part", "rank", "id")) -> None:
    """One folder of text files per base, the lines sorted inside each; a base is split over as many files as it needs."""
    rows = lines.repartitionByRange("kb_id", *order).sortWithinPartitions("kb_id", *order)
    rows.select("kb_id", F.col("line").alias("value")).write.partitionBy("kb_id").mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in every file and a byte order mark before it, as spreadsheets want; columns of plain types only."""
    first = df.columns[0]
    df.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """A whole set of datasets as JSON lines below ``path``, a folder for each and in it one for each base (kb_id)."""
    for name, df in tables.items():
        df.write.partitionBy("kb_id").mode("overwrite").json(f"{path}/{name}")
