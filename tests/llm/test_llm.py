"""The numbered operators: brute force, round trips and edge cases (nulls, empty, ties, repeats, clashing names)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import abuse, groups, mixing, names, nearest, pieces, queries, scans, tokens
from docloom.tables import read

from ..compare import DATA, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, DATA)) == rows_of_sql(queries.SQL[name])


@pytest.mark.parametrize("name", sorted({*queries.QUERIES} - {*queries.SQL}))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    n = df.count()
    assert n > 0 or name in ("p1_found",)


# --- p1 ---

_ENTITY = "id string, kb_id string, name string, normalized_name string, entity_type string, description string, extra string, form string, keys string"


def _entities(spark, rows):
    return spark.createDataFrame([(i, kb, n, None, t, d, "x", "y", "z") for i, kb, n, t, d in rows], _ENTITY)


def test_names_variants(spark):
    a = ["Theodore Quingaborg", "QUINGABORG, Ted", "Dr. Theodore Quingaborg", "Theodore  Quinagborg", "T. Quingaborg"]
    b = ["Lankafell Rail Safety Department", "Lankafell Rail Safety Dept.", "Dept for Rail Safety (Lankafell)", "Lankafell RSD", "The Lankafel Rail Safety Department (LRSD)"]
    c = ["墉湄原应用光学大学", "应用光学大学（墉湄原）", "墉湄原應用光學大學(简称墉应)", "墉湄原市应用光学大学"]
    other = ["Theodore Quingaborg Jr.", "Gregory Fallenvig", "Lankafell Rail Safety Institute", "Lankafell Ceramics Department", "墉湄原应用光学研究所", "Meter 5", "Meter 6", None, "", "  ", "!?"]
    rows = [(f"{g}{i}", "k", n, None, None) for g, xs in (("a", a), ("b", b), ("c", c), ("z", other)) for i, n in enumerate(xs)]
    rows += [("d1", "k2", a[0], None, None), ("n1", None, a[0], None, None), (None, "k", a[0], None, None)]
    got = {(r[0], r[1]) for r in names.variant_pairs(_entities(spark, rows)).collect()}
    want = {(f"{g}{i}", f"{g}{j}") for g, xs in (("a", a), ("b", b), ("c", c)) for i in range(len(xs)) for j in range(i + 1, len(xs))}
    assert got == want


def test_names_facts_and_series(spark):
    rows = [
        ("1", "k", "Anna Holm", "人物", "auditor at Staveby since 2001"), ("2", "k", "Anna Holm", "人物", "Auditor, Staveby (2001)"), ("3", "k", "Anna Holm", "人物", "hydrologist at Morby since 1990"),
        *[(f"s{i}", "k", f"Form ABC-{i:03}", "概念", None) for i in range(200)],
    ]
    assert {(r[0], r[1]) for r in names.variant_pairs(_entities(spark, rows)).collect()} == {("1", "2")}


def test_names_of_nothing(spark):
    assert names.variant_pairs(_entities(spark, [])).count() == 0
    assert names.variant_pairs(_entities(spark, [("1", "k", None, None, None)])).count() == 0


def test_name_helpers():
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and names.jaro_winkler("", "a") == 0
    assert names.one_edit("abc", "acb") and names.one_edit("abc", "ab") and not names.one_edit("abc", "cba")
    assert names.phonetic("quinhishaw") == names.phonetic("kuinhishaw")


# --- p2 ---


def _brute(rows, k):
    keys = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T).round(6)
    out = {}
    for i in range(len(rows)):
        order = sorted((-s[i, j], keys[j]) for j in range(len(rows)) if j != i)[:k]
        out[keys[i]] = [b for _, b in order]
    return out


def test_nearest_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 32))
    rows = [(f"v{i:05}", (centres[i % 30] + 0.4 * rng.normal(size=32)).tolist()) for i in range(3000)]
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, "key string, x array<double>"), "key", "x", 10).collect():
        got.setdefault(r.key, []).append(r.neighbour)
    want = _brute(rows, 10)
    assert np.mean([len({*got[k]} & {*want[k]}) / 10 for k in want]) >= 0.9
    assert all(len(v) == 10 for v in got.values())


def test_nearest_copies_and_dirt(spark):
    rows = [(f"c{i:02}", [1.0, 0.0, 0.0]) for i in range(14)] + [("d0", [2.0, 0.0, 0.0]), ("e0", [1.0, 1.0, 0.0]), ("e1", [1.0, 1.1, 0.0])]
    rows += [("null", None), ("zero", [0.0, 0.0, 0.0]), ("nan", [float("nan"), 1.0, 0.0]), ("short", [1.0, 0.0]), ("empty", []), (None, [1.0, 0.0, 0.0]), ("c00", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "key string, x array<double>").withColumn("v", F.lit(1)).withColumn("dim", F.lit("clash")).withColumn("n", F.lit(0))
    got = {}
    for r in nearest.nearest(df, "key", "x", 10).orderBy("key", F.desc("cosine"), "neighbour").collect():
        got.setdefault(r.key, []).append(r.neighbour)
    names_ = [f"c{i:02}" for i in range(14)] + ["d0"]
    assert got["c03"] == [k for k in names_ if k != "c03"][:10] and got["d0"] == names_[:10]
    assert got["e0"][0] == "e1" and got["e0"][1:] == names_[:9] and not {"null", "zero", "nan", "short", "empty"} & {*got}
    assert nearest.nearest(df.limit(0), "key", "x").count() == 0


def test_nearest_divides_large_partitions(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = [(f"v{i:04}", (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1500)]
    for name, value in (("TILE", 200), ("PARTITION", 60), ("SAMPLE", 64)):
        monkeypatch.setattr(nearest, name, value)
    df = spark.createDataFrame(rows, "key string, x array<double>")
    got = {}
    for r in nearest.nearest(df, "key", "x", 5).collect():
        got.setdefault(r.key, set()).add(r.neighbour)
    want = _brute(rows, 5)
    assert np.mean([len(got[k] & {*want[k]}) / 5 for k in want]) >= 0.9


def test_nearest_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"v{i:04}", rng.normal(size=8).tolist()) for i in range(400)]
    monkeypatch.setattr(nearest, "TILE", 60)
    df = spark.createDataFrame(rows, "key string, x array<double>")
    got = {}
    for r in nearest.nearest(df, "key", "x", 5).collect():
        got.setdefault(r.key, set()).add(r.neighbour)
    want = _brute(rows, 5)
    assert np.mean([len(got[k] & {*want[k]}) / 5 for k in want]) >= 0.95


def test_nearest_least_with_poor_codes(spark, monkeypatch):
    """Pairs far from all that centres and codebooks were fitted on: their codes say nothing of them."""
    rng = np.random.default_rng(8)
    centres, far = rng.normal(size=(2, 16)), rng.normal(size=(30, 16))
    rows = [(f"v{i:04}", (centres[i % 2] + 0.02 * rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(f"far{i:02}{side}", (far[i] + 0.05 * rng.normal(size=16)).tolist()) for i in range(30) for side in "ab"]
    monkeypatch.setattr(nearest, "SAMPLE", 64)
    df = spark.createDataFrame(rows, "key string, x array<double>")
    got = {(r.key, r.neighbour) for r in nearest.nearest(df, "key", "x", 10, 0.95).where("key like 'far%'").collect()}
    x = np.array([r[1] for r in rows[3000:]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(rows[3000 + i][0], rows[3000 + j][0]) for i, j in zip(*np.nonzero(x @ x.T >= 0.95)) if i != j}
    assert len(want) >= 60 and got == want


@pytest.mark.parametrize("least", [0.95, 0.5, -0.2])
def test_scan_reaches_all_and_little_more(least, monkeypatch):
    rng = np.random.default_rng(9)
    v = (rng.normal(size=(40, 30))[np.arange(2500) % 40] + 0.5 * rng.normal(size=(2500, 30))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index, one, ids, kept = nearest.Index(v, 700), np.ones(len(v), bool), np.arange(len(v)), {}
    reach, scan = index._reach, index._scan
    monkeypatch.setattr(index, "_reach", lambda *x: kept.setdefault("reach", reach(*x)))
    monkeypatch.setattr(index, "_scan", lambda *x: kept.setdefault("scores", []).append(scan(*x)) or kept["scores"][-1])
    got = {(n, m) for n, near, _ in index.search(0, ids, v, one, one, len(v), least) for m in near}
    exact = v.astype(np.float64) @ v.T.astype(np.float64)
    np.fill_diagonal(exact, -9)
    assert {*zip(*(x.tolist() for x in np.nonzero(exact >= least + 1e-6)))} <= got
    assert all(exact[n, m] >= least - 1e-6 for n, m in got)
    if least == 0.95:
        scores = np.concatenate(kept["scores"], 1)
        assert (scores >= kept["reach"][:, None]).sum() < (scores >= least - 0.3).sum() / 2  # 0.3 was the slack of all entries


# --- p3 ---


def test_groups_against_union_find(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(400):03}", f"n{rnd.randrange(400):03}") for _ in range(300)]
    edges += [("hub", f"n{i:03}") for i in range(0, 400, 9)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [(None, "a"), ("a", None), ("s", "s"), edges[0], edges[0][::-1]]
    got = {r.member: r.group for r in groups.connected_groups(spark.createDataFrame(edges, "l string, r string").withColumn("u", F.lit(1)).withColumn("v", F.lit(2)), "l", "r").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}


def test_groups_of_nothing(spark):
    assert groups.connected_groups(spark.createDataFrame([("a", "a")], "l string, r string"), "l", "r").count() == 0


# --- p4 ---


def _pieces(spark, text, limit, overlap, size):
    df = spark.createDataFrame([("k", 3, text)], "key string, page int, content string")
    r = pieces.text_ranges(df, "content", ["key", "page"], size)
    return pieces.split(r, "key", ["key", "page"], limit, overlap).orderBy("piece").collect()


@pytest.mark.parametrize("size", [1 << 16, 997, 300])
def test_pieces_cover_the_text(spark, size):
    rnd = random.Random(7)
    text = " \n" + "".join(rnd.choice(["word ", "Sentence end. ", "句子。", "\r\n\r\n", "\t  ", "x" * 30, "\r"]) for _ in range(1500)) + " \n "
    want = __import__("re").sub("[ \t]+", " ", __import__("re").sub("\r\n?", "\n", text)).strip(" \n")
    rows = _pieces(spark, text, 200, 40, size)
    assert [r.piece for r in rows] == list(range(len(rows))) and all(0 < len(r.content) <= 200 and r.page == 3 for r in rows)
    assert all(want[r.begin : r.end] == r.content for r in rows)
    done = 0
    for r in rows:
        assert r.begin <= done or not want[done : r.begin].strip(" \n")
        assert done - r.begin <= 40
        done = r.end
    assert done == len(want)


def test_pieces_edges(spark):
    rows = [("a", "x" * 900), ("b", "x" * 901), ("c", " " * 2000), ("d", None), ("e", ""), ("f", "y" * 899 + " \t\r\n "), ("g", "a \t" * 600)]
    df = spark.createDataFrame([(i, 0, None, t, "clash") for i, t in rows], "id string, chunk_index long, page_number long, content string, text string")
    assert {r[0] for r in pieces.long_chunks(df).collect()} == {"b", "g"}
    out = pieces.chunk_pieces(df).collect()
    assert {r.chunk_id for r in out} == {"b", "g"} and max(len(r.content) for r in out) <= 900
    # a run of white space over many ranges
    rows = _pieces(spark, "a" + " " * 3000 + "b" * 250, 200, 20, 100)
    assert rows[0].content == "a" and rows[-1].end == 252 and all(len(r.content) <= 200 for r in rows)
    with pytest.raises(ValueError):
        _pieces(spark, "a", 10, 10, 100)


def test_file_ranges(spark, tmp_path):
    text = "Zeile äöü 中文😀。 Next sentence. " * 200
    (tmp_path / "t.txt").write_text(text, encoding="utf-8")
    r = pieces.file_ranges(spark, str(tmp_path / "t.txt"), 1000)
    assert "".join(x.body for x in r.orderBy("range").collect()) == text
    rows = pieces.split(r, "path", ["path"]).orderBy("piece").collect()
    assert rows[-1].end == len(text.strip()) and all(len(x.content) <= 900 for x in rows)


# --- p5 ---


def test_scan_helpers():
    assert scans.page_number("Page 3 of 9") == (3, True) and scans.page_number("第5页 共7页") == (5, True) and scans.page_number("12 | Page") == (12, True)
    assert scans.page_number("xiv") == (14, False) and scans.page_number("- 8 -") == (8, True) and scans.page_number("mm word") is None
    assert scans.skeleton("HANDB0OK") == scans.skeleton("haridbook") == scans.skeleton("handbook") and scans.skeleton("毛册") == scans.skeleton("手册")
    assert ("kitchen", scans.RATIO, scans.LEAST) in scans.candidates("kifchen") and ("several", 2, 3) in scans.candidates("5everal")


def _scan_chunks(spark):
    body = "The quick brown fox jumped over the lazy dog near the river\nbank while the careful reader watched it from the window of\nthe small kitchen. "
    rows = []
    for d in range(4):
        for p in range(5):
            text = f"River survey handbook\n{body}"
            if (d, p) == (0, 1):
                text = "River survey hand8ook\n" + body.replace("kitchen", "kifchen").replace("window", "win-\ndow")
            rows.append((f"c{d}{p}", d, p, p + 1, text + f"\n- {p + 1} -"))
    rows += [("n1", 9, 0, None, "A well-\nknown native text with a compound at\nthe end of its line and 5 numbers"), ("n2", 9, 1, None, None), ("n3", 9, 2, None, ""), ("n4", 8, 0, None, "well-known well-known well-known")]
    return spark.createDataFrame(rows, "id string, document_id long, chunk_index long, page_number long, content string")


def test_frequent_entries(spark):
    df = spark.createDataFrame([(f"w{i}", i) for i in range(1000)], "gram string, n long")
    got = {r.gram for r in scans.frequent(df, 100).collect()}
    assert got <= {f"w{i}" for i in range(890, 1000)} and len(got) >= 90
    assert scans.frequent(df, 5000).count() == 1000 and scans.frequent(df.limit(0), 10).count() == 0


def test_scan_defects(spark):
    got = {(r.chunk_id, r.defect) for r in scans.defects(_scan_chunks(spark)).collect()}
    pages = {f"c{d}{p}" for d in range(4) for p in range(5)}
    assert {c for c, k in got if k == "header"} == pages and {c for c, k in got if k == "page_no"} == pages
    assert {c for c, k in got if k == "hyphen"} == {"c01"} and {c for c, k in got if k == "char"} == {"c01"}
    text = {r.chunk_id: r.text for r in scans.repaired(_scan_chunks(spark)).collect()}
    assert text["c01"] == text["c02"] and "handbook" not in text["c01"] and "window" in text["c01"] and "kitchen" in text["c01"] and "\n" not in text["c01"].strip()
    assert scans.defects(_scan_chunks(spark).limit(0)).count() == 0


# --- p6 ---


def _reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_tokens_fuzz():
    rnd = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "'re", "'", "S", "1", "２", "é", "中文", "😀", "​", "<|endoftext|>", "aaaa", "''''", "\r\n", "!?", "word", "　", "\x85", "\x1c"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(3000)] + [None, "", "x" * 5000, "'" * 999, " " * 777, "ab" * 2000]
    e = tokens.Encoder()
    for _ in range(2):  # the second time all words are known
        ids, ends = e.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(np.append(0, ends), ends)] == _reference(texts)


def test_tokens_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 500)
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    rows = [(i, t) for i, t in enumerate(["Hello world", None, "", "x " * 900, "中文" * 300, "Hello world"])] + [(0, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = sorted((r.doc_id, r.ids) for r in tokens.encode(df, "doc_id", "text").collect())
    assert got == sorted(zip((r[0] for r in rows), _reference([r[1] for r in rows])))
    n = {r.doc_id: r.n for r in tokens.count(df, "text", "n").collect()}
    assert n[1] == n[2] == 0 and n[0] == 2
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


# --- p7 ---


def test_mix_against_plain(spark):
    rnd = random.Random(3)
    docs = [(i, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([0, 1, 5, 40, None])) for i in range(600)]
    targets = [("m", "a", 0.5, 1, 0.3), ("m", "b", 0.3, 4, 0.3), ("m", "c", 0.2, 1, 3.0), ("m", "gone", 0.0, 1, 0.3), ("n", "a", 1.0, 3, 2.0), ("n", "b", None, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n long").withColumn("part", F.lit(0)).withColumn("local", F.lit(0))
    t = spark.createDataFrame(targets, "mix string, source string, target_share double, max_repeats int, size_ratio double")
    line = mixing.placed(d, "doc_id", "source", "n")
    rows = line.collect()
    total = sum(n for _, s, n in docs if s and n)
    by = {}
    for r in sorted(rows, key=lambda r: (r.source, r.upto)):
        by[r.source] = by.get(r.source, 0) + r.n
        assert by[r.source] == r.upto
    assert sum(by.values()) == total
    got = {}
    for r in mixing.draw(line, t, "doc_id", "source", "n").collect():
        got[r.mix, r.source] = got.get((r.mix, r.source), 0) + r.n * r.repeats
        assert r.repeats <= {("m", "a"): 1, ("m", "b"): 4, ("m", "c"): 1, ("n", "a"): 3}[r.mix, r.source]
    for mix, s, share, cap, ratio in targets:
        if s in by and share:
            want = min(share * ratio * total, by[s] * cap)
            assert abs(got.get((mix, s), 0) - want) <= 20
    assert mixing.draw(mixing.placed(d.limit(0), "doc_id", "source", "n"), t, "doc_id", "source", "n").count() == 0


# --- p8 ---


@pytest.mark.parametrize(
    "text",
    [
        "You are a pathetic moron and nobody wants you.", "You are a pathetic m***n and nobody wants you.", "you are a p@th3t1c s c u m b a g", "What a use​less lo​ser.", "Тhose refugees are vеrmіn and should be thrown out.",
        "I will find you and\nbreak your legs.", "All foreigners should be wiped off the map.", "Send me your nudes tonight, I am so horny.", "Du bist ein wertloser Versager, halt die Fresse.", "你就是个没用的蠢*货，给我滚。", "那些移民都是害虫，应该全部赶出去。", "ONLY A MORON COULD WRITE THIS.",
    ],
)
def test_abuse_found(text):
    assert abuse.score("The pump was checked. " + text + " The filter too.")[0] >= abuse.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [
        None, "", "  ", "Kill the stale worker process and abort the child job.", "The breast cancer screening unit moved.", "I honestly hate how slow the firing curve is, damn.", "Remove rats and other vermin from the grain store.",
        "The moderation guide tells clerks how to report insults, hate speech and pornography.", "Immigrants and locals work side by side here.", "The pump is a pig to start in winter.", "请将垃圾分类投放，防治人员将检查老鼠。", "审核指南说明如何举报辱骂与色情内容。", "5*3 and 2**8 = 256; a b c d",
    ],
)
def test_abuse_not_found(text):
    assert abuse.score(text)[0] < abuse.THRESHOLD


def test_abuse_rows(spark):
    df = spark.createDataFrame([(1, "You stupid idiot.", "a"), (1, "You stupid idiot.", "a"), (2, None, None), (3, "fine", "a")], "doc_id long, text string, source string").withColumn("score", F.lit(9)).withColumn("kind", F.lit("x"))
    assert [r.doc_id for r in abuse.abusive_documents(df).collect()] == [1]
    assert {r.source: (r.documents, r.flagged) for r in abuse.source_rates(df).collect()} == {"a": (3, 2), None: (1, 0)}
    assert abuse.scored(df.limit(0)).count() == 0


def test_agrees_with_labels(spark):
    """Raters err, so most of their clear verdicts must agree, not all."""
    found = {r.doc_id for r in abuse.abusive_documents(read(spark, DATA, "documents")).collect()}
    labels = read(spark, DATA, "labels").where("category is not null").collect()
    assert not labels or np.mean([(r.doc_id in found) == (r.category != "none") for r in labels]) >= 0.8
