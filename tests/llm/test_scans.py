"""Scanned pages: feet, short Chinese lines, chunks of one line, nearly equal lines, words across pages."""

import pytest

from docloom.llm import scans

COLUMNS = "id string, document_id long, chunk_index long, page_number long, content string"
LINES = [
    "The keeper of the archive wrote that every shelf was counted\ntwice before the winter, and that nothing had gone\nmissing since the last visit of the board.",
    "Each reading was taken from the middle of the scale because\nthe ends had been worn by long use, which the maker\nof the instrument had already warned about.",
    "Water from the upper basin runs through two filters first and\nis then kept in the settling tank until the morning,\nwhen the clerk opens the lower valve.",
    "A second copy of the plan hangs in the hall so that visitors\ncan follow the way of the parcels from the gate to\nthe scales and back.",
]


def _found(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS)
    return {(r.chunk_id, r.defect) for r in scans.defects(df).collect()}


def test_one_form_for_all_confusions():
    for right, read in [*(("x" + p[0] + "y", "x" + p[1] + "y") for p in scans.HAN_PAIRS), *scans.LATIN_PAIRS]:
        assert scans.skeleton(right) == scans.skeleton(read), (right, read)


def test_foot(spark):
    rows = [(f"c{i}", 1, i, i + 1, f"{t}\n\nPump Service Manual Rev C") for i, t in enumerate(LINES)]
    assert _found(spark, rows) == {(f"c{i}", "header") for i in range(4)}
    text = {r.chunk_id: r.text for r in scans.repaired(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert all("Manual" not in t and "\n" not in t for t in text.values()) and text["c0"].endswith("visit of the board.")


def test_last_line_and_next_first_line_are_no_running_line(spark):
    shared = "12 | 3.4 | valve"
    rows = [("a", 1, 0, None, f"{LINES[0]}\n\n{shared}"), ("b", 1, 1, None, f"{shared}\n\n{LINES[1]}")]
    assert _found(spark, rows) == set()


def test_nearly_equal_headers(spark):
    heads = ["Annual Harvest Statement", "Annual Harvest Statement", "Annual Harvst Statement", "Annual Harvest Statemcnt"]
    rows = [(f"c{i}", 1, i, i + 1, f"{h}\n{t}") for i, (h, t) in enumerate(zip(heads, LINES))]
    assert {c for c, k in _found(spark, rows) if k == "header"} == {"c0", "c1", "c2", "c3"}


def test_short_chinese_lines_and_single_lines(spark):
    page = "值班员记录了每一个\n读数，并且在每次交\n接时间之后再次确认\n，没有人提出异议。"
    rows = [(f"v{i}", 2, i, None, "交接时间到了。" * 5 + page) for i in range(20)]
    rows += [("han", 3, 0, 1, page.replace("时间", "时问")), ("page", 4, 0, 1, LINES[2]), ("line", 4, 1, 2, "The clerk filled the kifchen book."), *((f"k{i}", 5, i, None, "A kitchen book for every kitchen.") for i in range(40))]
    got = {(c, k) for c, k in _found(spark, rows) if k == "char"}
    assert got == {("han", "char"), ("line", "char")}


def test_every_page_and_words_across_pages(spark):
    rows = [("a", 1, 0, 1, f"{LINES[0]}\nAll of it was later found in the sto-"), ("b", 1, 1, 2, f"rehouse near the gate.\n{LINES[1]}"), ("c", 1, 2, 3, LINES[3])]
    rows += [(f"s{i}", 2, i, None, "The storehouse is closed.") for i in range(9)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("text", __import__("pyspark").sql.functions.lit(1))
    got = {r.chunk_id: (r.defects, r.text) for r in scans.repaired(df).collect()}
    assert set(got) == {"a", "b", "c"}  # document 2 has no page like a scan
    assert got["a"][1].endswith("found in the storehouse") and got["b"][1].startswith("near the gate.") and got["c"] == ([], " ".join(LINES[3].split("\n")))


def test_compounds_are_decided_by_counts(spark):
    counts = spark.createDataFrame([("email", 50), ("e-mail", 40), ("wellknown", 1), ("well-known", 9), ("window", 30), ("win-dow", 1), ("blue", 5), ("green", 5)], "gram string, n long")
    pairs = spark.createDataFrame([("email", "e-mail"), ("wellknown", "well-known"), ("window", "win-dow"), ("bluegreen", "blue-green"), ("zorgal", "zor-gal")], "value string, other string")
    assert {r.value for r in scans.broken_words(pairs, counts).collect()} == {"window", "zorgal"}


@pytest.mark.parametrize("content", [None, "", " \n ", "x" * 300_000, "\n" * 5000, "-\n-\n1\n2\n3", "a\r\nb\rc"])
def test_odd_contents(spark, content):
    df = spark.createDataFrame([("a", 1, 0, None, content), ("a", 1, 0, None, content), (None, None, None, None, content)], COLUMNS)
    scans.defects(df).collect()
    assert scans.repaired(df).count() <= 3
