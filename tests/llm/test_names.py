"""Jaro-Winkler decides on names; slips in short words need a fact that both descriptions state."""

import pytest

from docloom.llm import names


def _verdict(a, b, left=None, right=None):
    return names.same(names.parse(a, left), names.parse(b, right))


@pytest.mark.parametrize("a, b", [("Martin Meyer", "Marvin Meyer"), ("Anna Schmidt", "Anne Schmidt"), ("Laura Keller", "Lara Keller"), ("Robert Hale", "Roland Hale"), ("John Carter", "Joan Carter")])
def test_near_names_of_different_people(a, b):
    assert _verdict(a, b) == 0


@pytest.mark.parametrize("a, b", [("Theodore Quingaborg", "Theodore Quinagborg"), ("Katherine Lindqvist", "Kathy Lindquist"), ("Margaret Fallenvig", "Fallenvig, Peggy"), ("Benjamin Oddersen", "Ben Oddersen")])
def test_variants(a, b):
    assert _verdict(a, b) == 2


def test_facts_allow_and_forbid():
    assert _verdict("Laura Kellerton", "Lara Kellerton", "Vartovbury; auditor", "auditor at Vartovbury") == 2
    assert _verdict("Theodore Quingaborg", "Theodore Quinagborg", "Vartovbury; auditor", "Keljoholm; chemist") == 0


def test_facts_without_a_list_of_wordings(spark):
    rows = [(f"e{i}", f"Engaged {y} with the depot of {p}") for i, (y, p) in enumerate([(1990 + i, "Aby" if i % 2 else "Bcy") for i in range(40)])] + [("x", None), ("y", "")]
    usual = names.wording(spark.createDataFrame(rows, "id string, description string").withColumn("w", __import__("pyspark").sql.functions.lit(1)))
    assert {"engaged", "depot"} <= usual and not {"1990", "1991"} & usual
    said = [names.facts(t, usual) for t in ("Engaged 1990 with the depot of Aby", "engaged 1990", "engaged 1991", "Cdy, 1990", None, "")]
    assert "y:1990" in said[0] and "w:engaged" not in said[0]
    assert names.agree(said[0], said[1]) == 1 and names.agree(said[1], said[2]) == -1 and names.agree(said[0], said[4]) == 0 == names.agree(said[5], said[0])
    assert names.agree(["n:aby", "w:auditor"], ["n:aby", "w:chemist"]) == -1 and names.agree(["n:aby", "w:auditor"], ["n:aby", "w:chemist"], person=False) == 1
