"""Entities of one base whose names are so like that they may be one thing: a similarity join without all pairs.

A name is the set of its characters, each with its number of occurrence. A ratio of ``least``
between two names needs that many characters in common, so

- their lengths lie within a factor,
- among the rarest characters of both (a prefix as long as the bound allows) is a common one:
  pairs meet on that character and their base.

Both bounds lose no pair. A name inside a longer one meets it on the rarest four-letter piece
of the shorter. What is left is compared exactly.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.tables import Stage

from .graph import DEFAULT_TYPE

#: Least ratio of a candidate; least ratio and length of a name that lies inside the other (fixed values).
RATIO, INSIDE, PIECE = 0.72, 0.55, 4


def _pieces(name, n: int):
    """The distinct pieces of ``n`` characters of a name."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - n + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, F.lit(n))))


def _letters(name):
    """The characters of a name with their numbers of occurrence, each once."""
    all_ = F.filter(F.split(name, ""), lambda c: c != "")
    number = lambda c, i: F.size(F.filter(F.slice(all_, 1, i + 1), lambda d: d == c))
    return F.transform(all_, lambda c, i: F.concat(c, number(c, i).cast("string")))


def _rarest_first(forms: DataFrame, column: str) -> DataFrame:
    """form_id, kb_id, length and the array in ``column`` sorted by how many names hold an item."""
    items = forms.select("form_id", "kb_id", "length", F.explode(column).alias("item"))
    held = items.groupBy("item").agg(F.count(F.lit(1)).alias("held"))
    rows = items.join(held, "item").groupBy("form_id", "kb_id", "length").agg(F.sort_array(F.collect_list(F.struct("held", "item"))).alias("_s"))
    return rows.select("form_id", "kb_id", "length", F.transform("_s", lambda x: x["item"]).alias("items"))


def similar_names(entities: DataFrame) -> DataFrame:
    """kb_id, left_name, right_name, ratio: pairs of different normalised names of a base that may be one, the smaller name left.

    Names are compared once however many entities carry them. Null and blank names and null bases are left out.
    """
    stage = Stage(entities.sparkSession, "alias")
    names = entities.where("kb_id is not null").select("kb_id", T.normalize_name(F.col("name")).alias("name")).where("length(name) > 0").distinct()
    forms = names.withColumns({"form_id": F.xxhash64("kb_id", "name"), "length": F.length("name")})
    forms = stage.put(forms.withColumn("letters", _letters(F.col("name"))))
    share = RATIO / (2 - RATIO)  # of a name's characters that the other must have
    keep = F.col("length") - F.ceil(F.col("length") * share - 1e-9).cast("int") + 1
    rare = stage.put(_rarest_first(forms, "letters").select("form_id", "kb_id", "length", F.explode(F.slice("items", F.lit(1), keep)).alias("item")))
    a, b = rare.withColumnsRenamed({"form_id": "a", "length": "la"}), rare.withColumnsRenamed({"form_id": "b", "length": "lb"})
    near = F.least("la", "lb") >= F.greatest("la", "lb") * share - 1e-9
    met = a.join(b, ["kb_id", "item"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    side = lambda x: forms.select(F.col("form_id").alias(x), F.col("kb_id").alias(f"k{x}"), F.col("name").alias(f"n{x}"), F.col("letters").alias(f"l{x}"))
    shared = F.size(F.array_intersect("la", "lb"))
    like = met.join(side("a"), "a").join(side("b"), "b").where(2 * shared >= RATIO * (F.size("la") + F.size("lb")) - 1e-9)

    long_enough = forms.where(F.col("length") >= PIECE).withColumn("pieces", _pieces(F.col("name"), PIECE))
    probe = _rarest_first(long_enough, "pieces").select(F.col("form_id").alias("a"), "kb_id", F.col("length").alias("ls"), F.col("items")[0].alias("item"))
    held = long_enough.select(F.col("form_id").alias("b"), "kb_id", F.col("length").alias("ll"), F.explode("pieces").alias("item"))
    inner = probe.join(held, ["kb_id", "item"]).where((F.col("ls") < F.col("ll")) & (2 * F.col("ls") >= INSIDE * (F.col("ls") + F.col("ll")) - 1e-9)).select("a", "b").distinct()
    inner = inner.join(side("a"), "a").join(side("b"), "b").where(F.contains("nb", "na"))

    pairs = like.unionByName(inner).select(F.col("ka").alias("kb_id"), F.least("na", "nb").alias("left_name"), F.greatest("na", "nb").alias("right_name")).distinct()

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)])

    short = F.least(F.length("left_name"), F.length("right_name"))
    within = (short >= PIECE) & (F.contains("left_name", "right_name") | F.contains("right_name", "left_name"))
    rows = pairs.withColumn("ratio", ratio("left_name", "right_name"))
    return rows.where((F.col("ratio") >= RATIO) | (within & (F.col("ratio") >= INSIDE)))


def name_classes(entities: DataFrame) -> DataFrame:
    """kb_id, normalized_name, entity_type (null: empty), class_id (the smallest id), entities: entities of a base with one name and type.

    Null and blank names and null bases are left out; repeated rows of an id count once.
    """
    e = entities.where("kb_id is not null").select("kb_id", "id", T.normalize_name(F.col("name")).alias("normalized_name"), F.coalesce("entity_type", F.lit("")).alias("entity_type")).where("length(normalized_name) > 0")
    return e.groupBy("kb_id", "normalized_name", "entity_type").agg(F.min("id").alias("class_id"), F.countDistinct("id").alias("entities"))


def candidates(entities: DataFrame) -> DataFrame:
    """kb_id, left_id, right_id, ratio: classes of ``name_classes`` with similar names whose types allow one entity.

    Types allow it if they are equal or one is empty, the default or "other". Left is the one
    with the smaller normalised name. Equal names are one already and give no pair.
    """
    e = Stage(entities.sparkSession, "classes").put(name_classes(entities))
    left, right = (e.select("kb_id", F.col("class_id").alias(f"{s}_id"), F.col("normalized_name").alias(f"{s}_name"), F.col("entity_type").alias(f"{s}_type")) for s in ("left", "right"))
    rows = similar_names(entities).join(left, ["kb_id", "left_name"]).join(right, ["kb_id", "right_name"])
    open_ = ["", DEFAULT_TYPE, "其他"]
    fits = (F.col("left_type") == F.col("right_type")) | F.col("left_type").isin(open_) | F.col("right_type").isin(open_)
    return rows.where(fits).select("kb_id", "left_id", "right_id", F.round("ratio", 5).alias("ratio"))
