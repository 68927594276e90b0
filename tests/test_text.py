import pytest
from pyspark.sql import functions as F

from linkloom.functions import text


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Category:Calculus", "lculus"), ("Category:Category theory", " theory"), ("Category:Geometry", "Geometry"), ("Category:Cryptography", "ptography"), ("Category:Coordinate systems", "dinate systems"), ("Category:1763 works", "1763 works")],
)
def test_strip_category(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "c string").select(text.strip_category(F.col("c")).alias("loose"), text.strip_category(F.col("c"), True).alias("strict")).first()
    assert (row.loose, row.strict) == (want, raw.removeprefix("Category:"))


def kept(df, column="t"):
    return [r[column] for r in df.collect()]


def test_filters(spark):
    df = spark.createDataFrame([("Isomorphism theorems",), ("Graph Theory",), ("Help desk",), ("A:B",), ("ISBN",), (None,)], "t string")
    assert kept(text.without_substrings(df, "t", ["iso"])) == ["Graph Theory", "Help desk", "A:B", "ISBN"]
    once = text.without_substrings(df, "t", text.LINK_BLACKLIST)
    assert kept(once) == ["Isomorphism theorems", "Graph Theory"] == kept(text.without_substrings(once, "t", text.LINK_BLACKLIST))
    assert kept(text.without_words(df, "t", ["iso", "desk"])) == ["isomorphism theorems", "graph theory", "a:b", "isbn"]
    assert len(kept(text.without_substrings(df, "t", []))) == len(kept(text.without_words(df, "t", []))) == 5


def test_category_sets(spark):
    df = spark.createDataFrame([(["CS1 errors", "Math", "Math", None],), ([],), (None,)], "c array<string>")
    assert [r.x for r in df.select(text.category_set(F.col("c"), text.CATEGORY_BLACKLIST).alias("x")).collect()] == [["Math"], [], []]
