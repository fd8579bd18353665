"""Edge cases and brute-force checks of the core's operators."""

import difflib
import json
import random
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions import vectors as V
from docloom.operators import chunking, graph, retrieval
from docloom.operators.components import components


def test_pack_keeps_limits_and_text():
    text = "".join(f"第{i}句话，内容是测试。" for i in range(80))
    parts = chunking.pack(text, 260, 40)
    assert parts and all(0 < len(p) <= 260 for p in parts)
    assert all(f"第{i}句话" in "".join(parts) for i in range(80))


def test_pack_edges():
    assert chunking.pack(None, 10, 2) == [] and chunking.pack(" \n\n ", 10, 2) == []
    assert chunking.pack("a\r\n\r\nb", 10, 2) == ["a\n\nb"]
    assert chunking.pack("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    with pytest.raises(ValueError):
        chunking.pack("a", 5, 5)


def test_chunk_rows_and_udtf(spark):
    df = spark.createDataFrame([(1, "a。\nb" * 300), (2, None), (3, "")], "id long, t string")
    rows = chunking.chunk(df, "t", ["id"], 100, 10).collect()
    assert {r.id for r in rows} == {1} and [r.chunk_index for r in rows] == list(range(len(rows)))
    chunking.register(spark)
    df.createOrReplaceTempView("docs_for_udtf")
    n = spark.sql("select count(*) n from docs_for_udtf, lateral chunk_text(t, 100, 10)").first().n
    assert n == len(rows)


def test_text_functions(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("x {\"a\": 1} y",), ("garbage",), (None,), ("[1]",)], "t string")
    assert [r[0] for r in df.select(T.json_object(F.col("t"))).collect()] == ['{"a": 1}', '{"a": 1}', None, None, None]
    w = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (99.0,), (2.5,)], "w double")
    assert [r[0] for r in w.select(T.clamp_weight(F.col("w"))).collect()] == [1.0, 0.1, 0.1, 10.0, 2.5]
    n = spark.createDataFrame([("　A\t b\n",), ("",), (None,)], "n string")
    assert [r[0] for r in n.select(T.normalize_name(F.col("n"))).collect()] == ["a b", "", None]
    assert [r[0] for r in n.select(T.safe_filename(F.lit("a/b c?.txt"))).limit(1).collect()] == ["b_c_.txt"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0]), (None, [1.0])], "a array<float>, b array<float>")
    rows = df.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.normalize(F.col("a")).alias("n"), V.from_blob(V.to_blob(F.col("a"))).alias("r")).collect()
    assert rows[0].d == 3.0 and rows[0].n == pytest.approx([0.6, 0.8]) and rows[0].r == [3.0, 4.0]
    assert rows[1].d is None and rows[1].n is None and rows[2].d is None


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(300)}", f"n{rnd.randrange(300)}") for _ in range(220)] + [("hub", f"n{i}") for i in range(50)] + [(f"c{i}", f"c{i + 1}") for i in range(60)]
    edges += [(None, "n1"), ("n1", None), ("self", "self")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


_REL = "id string, kb_id string, source_id string, target_id string, predicate string, description string, weight double, evidence_chunk_id string, created_at timestamp"


def _relations(spark, pairs):
    return spark.createDataFrame([(f"r{i:04}", "k", a, b, None, None, w, None, None) for i, (a, b, w) in enumerate(pairs)], _REL)


def _plain_labels(pairs):
    around = {}
    for a, b, w in pairs:
        if a != b:
            for x, y in ((a, b), (b, a)):
                around.setdefault(x, {})[y] = around.setdefault(x, {}).get(y, 0.0) + w
    label = {n: n for n in around}
    for _ in range(12):
        changed = False
        for n in sorted(around, key=lambda n: (-len(around[n]), n)):
            s = {}
            for m, w in sorted(around[n].items()):
                s[label[m]] = s.get(label[m], 0.0) + w
            best = min(s, key=lambda x: (-s[x], x))
            changed |= best != label[n]
            label[n] = best
        if not changed:
            break
    return label


def test_label_propagation_is_exact_by_component(spark):
    rnd = random.Random(8)
    pairs = [(f"e{rnd.randrange(90):02}", f"e{rnd.randrange(90):02}", float(rnd.choice([1, 2, 3]))) for _ in range(110)]
    got = {r.entity_id: r.community for r in graph.communities(_relations(spark, pairs)).collect()}
    # relations of equal ends and predicate are one entry each in the log, weights add up
    assert got == _plain_labels(pairs)
    e = spark.createDataFrame([("k", "e00"), ("k", "alone"), ("k", "alone")], "kb_id string, id string")
    both = graph.communities(_relations(spark, [("e00", "e01", 1.0)]), e).collect()
    assert {(r.entity_id, r.community) for r in both if r.entity_id != "e01"} == {("e00", "e01"), ("alone", "alone")} and len(both) == 3


def test_labels_do_not_depend_on_size(spark, monkeypatch):
    rnd = random.Random(5)
    pairs = [("x", "y", 1.0), *((f"l{i}", f"r{j}", 0.1) for i in range(2) for j in range(3))]
    pairs += [(f"e{rnd.randrange(25):02}", f"e{rnd.randrange(25):02}", rnd.choice([0.1, 0.2, 0.3, 0.7])) for _ in range(45)]
    pairs = [*{(a, b): (a, b, w) for a, b, w in pairs}.values()]
    want = {r.entity_id: r.community for r in graph.communities(_relations(spark, pairs)).collect()}
    assert want == _plain_labels(pairs)
    monkeypatch.setattr(graph, "LPA_TASK_EDGES", 0)
    assert {r.entity_id: r.community for r in graph.communities(_relations(spark, pairs)).collect()} == want


def test_synchronous_labels_keep_components(spark):
    pairs = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 1.0)]
    rows = graph.synchronous_labels(graph.adjacency(_relations(spark, pairs))).collect()
    label = {r.entity_id: r.community for r in rows}
    assert label["a"] == label["b"] == label["c"] and label["x"] in "xy" and label["y"] in "xy"


def test_members_are_not_cut(spark, tmp_path):
    from docloom.plans import registry

    rows = [(f"e{i:03}", "k", None if i == 7 else f"n{i * 37 % 120:03}", None, None if i % 2 else "概念", None, None) for i in range(120)]
    e = spark.createDataFrame(rows, "id string, kb_id string, name string, normalized_name string, entity_type string, description string, created_at timestamp")
    e.write.parquet(str(tmp_path / "entities.parquet"))
    _relations(spark, [("e000", f"e{i:03}", 1.0) for i in range(1, 120)] + [("e000", "gone", 1.0)]).write.parquet(str(tmp_path / "relationships.parquet"))
    order = [r[0] for r in sorted(rows, key=lambda r: (r[2] or "", r[0]))]
    got = registry.QUERIES["type_members"](spark, str(tmp_path)).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == order and {(r.entity_type, r.members) for r in got} == {("概念", 120)}
    got = registry.QUERIES["community_members"](spark, str(tmp_path)).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == order
    assert {r.members for r in got} == {120} and len({r.community for r in got}) == 1 and [r.position for r in sorted(got, key=lambda r: r.position)] == [*range(120)]


def test_reducers_ties_and_nulls(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    e = spark.createDataFrame(
        [("2", "k", " Alpha ", None, "概念", "bb", t), ("1", "k", "alpha", None, None, "aa", t), ("3", "k", "ALPHA", None, "组织", "", t), ("4", "k", None, None, "x", "y", t), ("5", "k", "  ", None, "x", "y", t)],
        "id string, kb_id string, name string, normalized_name string, entity_type string, description string, created_at timestamp",
    )
    (row,) = graph.entity_upsert(e).collect()
    assert (row.id, row.name, row.entity_type, row.description, row.rows) == ("1", "alpha", "组织", "aa", 3)
    r = _relations(spark, [("a", "b", float("nan")), ("a", "b", 50.0), ("a", "a", 1.0), ("a", None, 1.0)])
    (row,) = graph.relation_upsert(r).collect()
    assert (row.weight, row.predicate, row.rows, row.evidence_chunk_id) == (10.0, graph.DEFAULT_PREDICATE, 2, None)
    assert graph.relation_upsert(r.limit(0)).count() == 0


def test_history_budget(spark):
    turns = [("c", i, "system" if i % 7 == 0 else "user" if i % 2 else "assistant", "x" * (7000 if i > 20 else 10)) for i in range(30)] + [("c", 30, "user", ""), ("c", 31, "user", None)]
    rows = retrieval.history(spark.createDataFrame(turns, "conversation string, turn int, role string, content string")).collect()
    left, want = 24_000, {}
    for c, i, role, text in reversed(turns[-20:]):
        if role == "system" or not text or left <= 0:
            continue
        want[i] = min(6000, len(text), left)
        left -= want[i]
    assert {r.turn: len(r.content) for r in rows} == want


def test_batch_top_k_blocks(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(200)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.batch_top_k(v, q, "id", "v", 5, block=37).collect()}
    for i, x in rows:
        if i % 50 == 0:
            best = sorted((-round(sum(a * b for a, b in zip(x, y)), 5), j) for j, y in rows)[:5]
            assert [got[i, k + 1] for k in range(5)] == [j for _, j in best]


def test_numbered_hot_group(spark):
    from docloom.operators.ranking import numbered

    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i * 7919 % 1009, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o int, i int")
    got = {r.i: r.n for r in numbered(df, "g", [F.col("o"), F.col("i")], "n").collect()}
    want, seen = {}, {}
    for g, o, i in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    assert got == want and numbered(df.limit(0), "g", [F.col("o")], "n").count() == 0


def test_whole_questions_of_both_lengths(spark, tmp_path):
    from docloom.plans import registry

    text = "开头 " * 200 + "Acme Works 在末尾"
    chunks = [(f"c{i}", d, "k", text if i < 2 else "x", [float(i == j) for j in range(64 if i % 2 else 48)]) for i, d in enumerate((50, 50, 100, 7, 7))]
    spark.createDataFrame(chunks, "id string, document_id long, kb_id string, content string, embedding array<float>").withColumn("embedding_dim", F.size("embedding").cast("long")).write.parquet(str(tmp_path / "chunks.parquet"))
    e = [("e1", "k", "ACME  works", None), ("e2", "k", "Acme Workshop", None), ("e3", "other", "acme works", None), ("e4", "k", "在末", None), ("e5", "k", "在", None)]
    spark.createDataFrame(e, "id string, kb_id string, name string, normalized_name string").write.parquet(str(tmp_path / "entities.parquet"))
    got = {(r.query_id, r.entity_id) for r in registry.QUERIES["entities_named_in_all_questions"](spark, str(tmp_path)).collect()}
    assert got == {(q, i) for q in ("c0", "c1") for i in ("e1", "e4")}
    got = {(r.query_id, r.chunk_id) for r in registry.QUERIES["rerank_all_questions"](spark, str(tmp_path)).collect()}
    assert got == {(q, c) for q in ("c0", "c2") for c in ("c0", "c2", "c4")} | {("c1", "c1"), ("c1", "c3")}


def test_rank_by_base_blocks(spark):
    rnd = random.Random(4)
    rows = [(f"c{i:03}", f"k{i % 3}", [rnd.uniform(-1, 1) for _ in range(4 + i % 2)]) for i in range(150)] + [("none", "k0", None)]
    c = spark.createDataFrame(rows, "id string, kb_id string, embedding array<float>")
    q = c.select("kb_id", F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    sets = [{(r.query_id, r["rank"], r.chunk_id, r.score) for r in retrieval.rank_by_base(c, q, 5, block=n).collect()} for n in (7, 20_000)]
    assert sets[0] == sets[1] and len(sets[0]) == 750


def test_search_modes(spark):
    with pytest.raises(ValueError):
        retrieval.search("other", None, None, None, None, None)


def _office(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)


def test_sources(spark, tmp_path):
    from docloom.sources import files

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>".format
    _office(tmp_path / "a.docx", {"word/document.xml": f"<w:document {w}><w:body>{p('Hello')}{p(' ')}<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl></w:body></w:document>"})
    _office(tmp_path / "b.pptx", {f"ppt/slides/slide{i}.xml": f"<x {a}><a:p><a:r><a:t>{t}</a:t></a:r></a:p></x>" for i, t in ((1, "One"), (2, " "), (10, "Ten"))})
    _office(tmp_path / "c.xlsx", {"xl/workbook.xml": f"<workbook {s}><sheets><sheet name='S'/></sheets></workbook>", "xl/sharedStrings.xml": f"<sst {s}><si><t>v</t></si></sst>", "xl/worksheets/sheet1.xml": f"<worksheet {s}><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>2</v></c></row><row/></sheetData></worksheet>"})
    (tmp_path / "d.txt").write_bytes("中文".encode("gb18030"))
    (tmp_path / "e.html").write_text("<html><title>T</title><script>no</script><p>Hi <b>you</b></p></html>")
    (tmp_path / "f.csv").write_text('a, b\n"c|1",d\n')
    (tmp_path / "g.json").write_text('{"k":[1]}')
    (tmp_path / "h.json").write_text("{broken")
    (tmp_path / "i.exe").write_text("x")
    rows = {(r.filename, r.page_number or 0): r for r in files.read_sections(spark, str(tmp_path)).collect()}
    assert rows["a.docx", 0].text == "Hello\n表格 1\nx | y"
    assert rows["b.pptx", 1].text == "One" and rows["b.pptx", 10].text == "Ten" and ("b.pptx", 2) not in rows
    assert rows["c.xlsx", 0].text == "v |  | 2" and rows["d.txt", 0].text == "中文"
    assert rows["e.html", 0].text == "Hi\nyou" and rows["e.html", 0].metadata == '{"title": "T"}' and rows["f.csv", 0].text == "a | b\nc|1 | d"
    assert rows["g.json", 0].text == '{\n  "k": [\n    1\n  ]\n}'
    assert rows["h.json", 0].error and rows["i.exe", 0].error
    small = {r.filename: r.error for r in files.read_sections(spark, str(tmp_path), max_bytes=10).collect()}
    assert "too large" in small["e.html"] and small["d.txt"] is None


def test_exports(spark, tmp_path):
    from docloom.exports import lines

    nodes = spark.createDataFrame([("k", "1", 'A "<&', "组织", "x", 1, 3), ("k", "2", "B", None, None, 2, 0), ("z", "3", "C", "t", "", 1, 0)], "kb_id string, id string, name string, entity_type string, description string, rank int, mention_count int")
    edges = spark.createDataFrame([("k", "e", "1", "2", "p|q", None, 1.5)], "kb_id string, id string, source_id string, target_id string, predicate string, description string, weight double")
    text = lambda df, kb: "\n".join(r.line for r in df.where(F.col("kb_id") == kb).orderBy("part", "rank", "id").collect())
    for make in (lines.graphml, lines.gexf, lines.svg):
        for kb, n, e in (("k", 2, 1), ("z", 1, 0)):
            tags = [x.tag.rpartition("}")[2] for x in ElementTree.fromstring(text(make(nodes, edges), kb).encode()).iter()]
            assert (tags.count("node") or tags.count("circle")) == n and (tags.count("edge") or tags.count("line")) == e
            assert tags.count("key") == (5 if make is lines.graphml else 0) and (make is not lines.svg or tags.count("text") == n)
    g = json.loads(text(lines.graph_json(nodes, edges), "k"))
    assert [n["name"] for n in g["nodes"]] == ['A "<&', "B"] and g["edges"][0]["weight"] == 1.5 and json.loads(text(lines.graph_json(nodes, edges), "z"))["edges"] == []
    assert [r.line for r in lines.mermaid(nodes, edges).where("kb_id = 'k'").orderBy("part", "rank").collect()] == ["  n0[\"A '<&\"]", '  n1["B"]', "  n0 -->|p/q| n1"]
    m = text(lines.graph_markdown(spark.createDataFrame([("k", "Base")], "kb_id string, title string"), nodes, edges), "k")
    assert m.startswith("# Base · 知识图谱\n\n- 实体：2\n- 关系：1") and "- **B**（）：—" in m and m.endswith('- **A "<&** —p|q→ **B**（权重 1.5）：—')
    lines.write(lines.graphml(nodes, edges), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("kb_id = 'k'").count() == 8 + 2 + 1 + 2
    lines.write_csv(nodes.select("id", "name"), str(tmp_path / "csv"))
    assert {r["name"] for r in spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()} == {'A "<&', "B", "C"}
    lines.snapshot({"nodes": nodes, "edges": edges}, str(tmp_path / "all"))
    assert spark.read.json(str(tmp_path / "all" / "nodes")).where("kb_id = 'k'").count() == 2


def test_answers_to_logs(spark):
    from docloom.operators import extraction

    e = [{"name": f"N{i}", "type": "t"} for i in range(14)]
    texts = {
        "fence": '```json\n{"entities": [{"name": "  Big   Pump ", "type": null, "description": "d"}, "odd", {"type": "t"}, {"name": " "}], "relationships": [{"source": "BIG PUMP", "target": "Valve"}]}\n```',
        "prose": 'Sure: {"entities": {}, "relationships": [{"source": "A", "target": "a "}, {"source": "A", "target": "B", "predicate": " x  y ", "weight": "99"}, {"source": "A", "target": "B", "weight": "many"}, {"source": "", "target": "B"}, {"source": "C", "target": "D", "predicate": " "}, 5]}',
        "many": json.dumps({"entities": e, "relationships": [{"source": "N0", "target": f"N{i}"} for i in range(20)]}),
        "list": "[1, 2]", "cut": '{"entities": [{"name": "A"', "none": None, "empty": "",
    }
    df = spark.createDataFrame([("k", c, t, "z") for c, t in texts.items()], "kb_id string, chunk_id string, answer string, id string")
    assert {r.chunk_id for r in extraction.parsed(df).where("valid").collect()} == {"fence", "prose", "many"}
    entities, relations = extraction.logs(df)
    got = {(r.chunk_id, r.name): (r.entity_type, r.mentioned) for r in entities.collect()}
    assert got["fence", "Big Pump"] == ("概念", True) and got["fence", "Valve"] == ("概念", False) and got["prose", "A"] == ("概念", False)
    assert {n for c, n in got if c == "fence"} == {"Big Pump", "Valve"} and {n for c, n in got if c == "prose"} == {"A", "B"}
    assert sum(c == "many" and m for (c, _), (_, m) in got.items()) == 12
    r = [(x.predicate, x.weight) for x in relations.where("chunk_id = 'prose'").orderBy("position").collect()]
    assert r == [("x y", 10.0), ("相关", 1.0)] and relations.where("chunk_id = 'many'").count() == 17
    assert entities.where("chunk_id = 'fence' and position >= 12").count() == 1
    assert all(x.count() == 0 for x in extraction.logs(df.limit(0)))


def _similar(a, b):
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    short, long = sorted((a, b), key=len)
    return ratio >= 0.72 or (len(short) >= 4 and short in long and ratio >= 0.55)


def test_alias_candidates_are_all_of_them(spark):
    from docloom.operators import alias

    rnd = random.Random(3)
    stems = ["pump station", "北桥水文大学", "keljoholm", "seed vault unit", "灌溉", "abcd", "aab", "x"]
    names = [None, "", " "]
    for _ in range(160):
        n = list(rnd.choice(stems) + rnd.choice(["", "", " 2", " annex", "部", " of the north"]))
        for _ in range(rnd.randrange(4)):
            i = rnd.randrange(len(n) + 1)
            n[i : i + rnd.randrange(2)] = rnd.choice("aeptx 水大")
        names.append("".join(n))
    rows = [(f"e{i:03}", rnd.choice("kz"), n, rnd.choice(["t", "u", None, "概念"])) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id string, kb_id string, name string, entity_type string").withColumn("item", F.lit(1)).withColumn("a", F.lit(2))
    plain = lambda n: " ".join((n or "").split()).lower()
    want, first = set(), {}
    for x, kb, n, t in rows:
        first.setdefault((kb, plain(n), t or ""), x)
    for i, (_, kb, n, t) in enumerate(rows):
        for _, kb2, m, u in rows[i + 1 :]:
            (a, p), (b, q) = sorted(((plain(n), first[kb, plain(n), t or ""]), (plain(m), first.get((kb, plain(m), u or "")))), key=lambda x: x[0])
            if kb == kb2 and a and b and a != b and (t == u or {t, u} & {None, "概念"}) and _similar(a, b):
                want.add((p, q))
    got = [(r.left_id, r.right_id) for r in alias.candidates(df).collect()]
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want
    assert alias.candidates(df.limit(0)).count() == 0


def test_community_upkeep_and_ids(spark):
    e = spark.createDataFrame([(str(i), f"n{i}", "t") for i in range(6)], "id string, name string, entity_type string")
    m = spark.createDataFrame([("k", str(i), "a" if i < 3 else "b") for i in range(6)], "kb_id string, entity_id string, community string")
    before, now = graph.community_ids(m, e), graph.community_ids(m.where("entity_id <> '5'"), e.repartition(3))
    a = {r.community: r.community_id for r in before.collect()}
    b = {r.community: r.community_id for r in now.collect()}
    assert a["a"] == b["a"] and a["b"] != b["b"]
    assert {(r.community_id, r.state) for r in graph.upkeep(before, now).collect()} == {(a["a"], "kept"), (a["b"], "stale"), (b["b"], "new")}
    assert [(r.rank, r.community, r.member_count) for r in graph.by_size(m.where("entity_id <> '0'")).orderBy("rank").collect()] == [(1, "b", 3), (2, "a", 2)]


def test_global_search_and_context(spark):
    q = spark.createDataFrame([("k", "q1", "x", [1.0, 0.0]), ("k", "q3", "x", [0.0, 0.0, 1.0]), ("none", "q2", "x", [1.0, 0.0])], "kb_id string, query_id string, query_text string, query_vector array<double>")
    members = spark.createDataFrame([("k", "a", "e1"), ("k", "a", "e2"), ("k", "b", "e3"), ("k", "c", "e4")], "kb_id string, community string, entity_id string")
    mentions = spark.createDataFrame([("e1", "c1", 1), ("e2", "c1", 5), ("e2", "c2", 1), ("e3", "c3", 1), ("e4", "c4", 1)], "entity_id string, chunk_id string, mention_count long")
    chunks = spark.createDataFrame([("c1", "k", 1, None, "one", [1.0, 0.0]), ("c2", "k", 1, 3, "two", [0.0, 1.0]), ("c3", "k", 1, 0, "three", [0.6, 0.8]), ("c4", "k", 1, None, "four", None)], "id string, kb_id string, document_id long, page_number long, content string, embedding array<float>")
    v = {r.community: r.embedding for r in retrieval.community_vectors(members, mentions, chunks).collect()}
    assert {*v} == {"a", "b"} and v["a"] == pytest.approx([0.5**0.5] * 2) and v["b"] == pytest.approx([0.6, 0.8])
    told = spark.createDataFrame([("k", c, f"T{c}", f"S{c}", 2) for c in "abc"], "kb_id string, community string, title string, summary string, member_count long")
    told = told.join(retrieval.community_vectors(members, mentions, chunks), ["kb_id", "community"], "left")
    found = retrieval.search("graph_global", q, chunks, None, None, None, communities=told)
    assert [(r.query_id, r["rank"], r.community, r.score) for r in found.orderBy("query_id", "rank").collect()] == [("q1", 1, "a", 0.70711), ("q1", 2, "b", 0.6)]
    with pytest.raises(ValueError):
        retrieval.search("graph_global", q, chunks, None, None, None)
    facts = spark.createDataFrame([("q1", 1, "A", "B", "p", "d")], "query_id string, rank int, source string, target string, predicate string, description string")
    docs = spark.createDataFrame([(1, "f.txt")], "doc_id long, filename string")
    out = {r.query_id: r.context for r in retrieval.context(q, retrieval.rank_by_base(chunks, q, 2), chunks, docs, facts, found).collect()}
    assert out["q1"] == "[来源1] 文件：f.txt\none\n\n[来源2] 文件：f.txt\nthree\n\n[图关系1] A —p→ B。d\n\n[图社区1] Ta（2 个实体）\nSa\n\n[图社区2] Tb（2 个实体）\nSb"
    assert out["q2"] == out["q3"] == retrieval.NO_EVIDENCE


def test_blocks_of_queries(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3 if i % 4 else 2).tolist()) for i in range(150)] + [(900, None), (901, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = df.where("id % 3 = 0 or id >= 900").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    one, many = ({tuple(r) for r in retrieval.batch_top_k(df, q, "id", "v", 4, block, ask).collect()} for block, ask in ((1000, 1000), (20, 7)))
    assert one == many and len(one) == 50 * 4


def test_ingest(spark, tmp_path):
    from docloom.functions.embedding import hashed_words, missing
    from docloom.operators import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("First sentence. " * 200)
    (tmp_path / "in" / "b.json").write_text("{")
    docs, chunks = ingest.ingest(spark, str(tmp_path / "in"), "k1")
    assert {(r.filename, r.status) for r in docs.collect()} == {("a.txt", "ready"), ("b.json", "error")}
    rows = chunks.collect()
    assert {r.metadata_json for r in rows} == {"{}"} and sorted(r.chunk_index for r in rows) == list(range(len(rows)))
    assert len(rows) > 3 and len({r.id for r in rows}) == len(rows) and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)
    out = str(tmp_path / "out")
    ingest.store(chunks, out)
    ingest.store(chunks.withColumn("kb_id", F.lit("k2")), out)
    ingest.replace_base(chunks.limit(1), out)
    assert {(r.kb_id, r["count"]) for r in spark.read.parquet(out).groupBy("kb_id").count().collect()} == {("k1", 1), ("k2", len(rows))}
    bare = spark.createDataFrame([("1", "text", None, 0), ("2", None, None, 0), ("3", "x", [1.0], 1)], "id string, content string, embedding array<float>, embedding_dim long")
    assert {(r.id, r.embedding_dim) for r in missing(bare, hashed_words(8)).collect()} == {("1", 8), ("2", 0)}
