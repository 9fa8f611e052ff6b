import pytest
from pyspark.sql import functions as F

from pairwright.functions import cleaning
from pairwright.operators import linking
from pairwright.operators.linking import ColumnLink


def cells(spark, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string")
    c = F.col("c")
    return [tuple(r)[1:] for r in df.select("k", cleaning.clean_value(c), cleaning.is_missing(c), cleaning.is_invalid(c)).orderBy("k").collect()]


def test_numbers(spark):
    got = cells(spark, ["1,234", "$45,609", "  42.5  ", "-3.2", "0", "1e3", ".5", "5."])
    assert [x[0] for x in got] == [1234.0, 45609.0, 42.5, -3.2, 0.0, 1000.0, 0.5, 5.0]
    assert not any(x[1] or x[2] for x in got)


def test_missing_tokens(spark):
    tokens = ["", "NA", "n/a", "NULL", "None", "-", ".", "nan", "#N/A", "  NA  ", "$", ",", None]
    assert all(x == (None, True, False) for x in cells(spark, tokens))


def test_garbage_is_invalid(spark):
    assert all(x == (None, False, True) for x in cells(spark, ["abc", "12x", "1.2.3", "inf", "-inf", "1e999", "1d", "1f", "1_000", "0x10"]))


def test_prefix_of_statistics(spark):
    df = spark.createDataFrame([("12x",), ("x12",), ("1e2y",), ("NA",)], "c string")
    assert [r[0] for r in df.select(cleaning.numeric_prefix(F.col("c"))).collect()] == [12.0, None, 100.0, None]


def test_numeric_columns_lose_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "c double")
    assert [r[0] for r in df.select(cleaning.number_or_null(F.col("c"))).collect()] == [1.0, None, None, None]


def test_common_links():
    links = linking.common_links(["id", " a ", "b", "", "x"], ["b", "a", "", "y"], exclude=["x"])
    assert links == [ColumnLink("a", 1, 1), ColumnLink("b", 2, 0)]
    assert linking.common_links(["a", "b"], ["a", "b"], exclude=[" b "]) == [ColumnLink("a", 0, 0)]


def test_ambiguous_names():
    with pytest.raises(ValueError, match="Duplicate column name"):
        linking.common_links(["a", "a", "b"], ["a", "b"])
    assert linking.suggest_links(["a", "a", "b"], ["a", "b"]) == [ColumnLink("b", 2, 1)]
    assert linking.ambiguous_headers(["a", "a", "c", "c"], ["a", "b"]) == ["a"]
    assert linking.common_links(["a", "a", "b"], ["a", "b"], exclude=["a"]) == [ColumnLink("b", 2, 1)]


def test_explicit_links():
    with pytest.raises(ValueError, match="linked 2 times"):
        linking.validated([ColumnLink("a", 0, 0), ColumnLink("b", 0, 1)])
    links = linking.add_link([ColumnLink("a", 0, 0)], ["a", " b "], 1, 1)
    assert links[1].name == "b"
    assert linking.unlinked(links, ["a", "b", "c"], "target") == [2]
    with pytest.raises(ValueError, match="No active"):
        linking.without(links, ["a", "b"])


def test_personal_headers():
    found = linking.personal_headers(["First Name", "pct_name", "birthday", "ZIP", "income", "email address"], "target")
    assert [(h, why) for _, h, why in found] == [("First Name", "May contain first names"), ("birthday", "May contain dates of birth"), ("ZIP", "May contain ZIP codes"), ("email address", "May contain street addresses")]
