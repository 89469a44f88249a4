import pytest
from pyspark.sql import functions as F

from millrace.operators import batch as B


def text(spark, *docs):
    return spark.createDataFrame([(d,) for d in docs], "text string")


def test_word_count(spark):
    got = {r.word: r.n for r in B.word_count(text(spark, "The quick-brown fox.", "THE é fox_2", None, "")).collect()}
    assert got == {"the": 2, "quick": 1, "brown": 1, "fox": 2, "2": 1}


def test_skew_is_strictly_over_the_fan_out(spark):
    rows = spark.createDataFrame([("hotkey",)] * 1000 + [("warm",)] * 100 + [("cold",)], "k string")
    assert [r.label for r in B.skewed_keys(rows, "k").collect()] == ["hotkey(1000)"]


def test_shuffle_stats(spark):
    rows = spark.createDataFrame([("a", "xx"), ("b", "é"), ("b", "y")], "k string, v string")
    r = B.shuffle_stats(rows, F.col("k"), F.col("v"), F.ascii("k") % 3).first()
    assert (r.pairs, r.bytes, r.partitions, r.max_share) == (3, 8, "1 2", pytest.approx(2 / 3))
    r = B.shuffle_stats(rows.limit(0), F.col("k"), F.col("v"), F.lit(0)).first()
    assert (r.pairs, r.bytes, r.partitions, r.max_share) == (0, 0, "", 0)


def test_join_and_its_keys(spark):
    people = spark.createDataFrame([("dept:eng", "alice"), ("dept:eng", "bob"), ("dept:ops", "carol"), (None, "x")], "k string, l string")
    depts = spark.createDataFrame([("dept:eng", "Engineering"), ("dept:ops", "Operations"), (None, "y")], "k string, r string")
    got = sorted(r.joined for r in B.reduce_side_join(people, depts, "k", "l", "r").collect())
    assert got == ["alice+Engineering", "bob+Engineering", "carol+Operations"]
    row = spark.range(1).select(B.extract_join_key(F.lit("a#b#c")).alias("x"), B.extract_join_key(F.lit("abc")).alias("y"), B.encode_join_input(F.lit(1), F.lit("k")).alias("z")).first()
    assert tuple(row) == ("c", "abc", "1#k")


def test_pagerank(spark):
    star = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("c", "hub"), ("hub", "a")], "src string, dst string")
    got = {r.id: r["rank"] for r in B.pagerank(star, 30).collect()}
    assert got["hub"] == pytest.approx(0.4780, abs=5e-5) and got["a"] == pytest.approx(0.4470, abs=5e-5)
    assert got["b"] == got["c"] == pytest.approx(0.0375) and sum(got.values()) == pytest.approx(1)
    leak = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert sum(r["rank"] for r in B.pagerank(leak, 30).collect()) == pytest.approx(0.214, abs=5e-4)
    assert sum(r["rank"] for r in B.pagerank(leak, 30, redistribute=True).collect()) == pytest.approx(1)
    assert B.pagerank(leak.limit(0), 3).count() == 0


def test_folds_in_python_and_splits(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v long")
    got = B.group_fold(rows, "k", lambda f: f.groupby("k", as_index=False).v.agg(lambda v: int("".join(map(str, sorted(v))))), "k string, v long")
    assert {tuple(r) for r in got.collect()} == {("a", 12), ("b", 5)}
    assert B.split_input(spark.range(100), F.col("id"), 4).rdd.getNumPartitions() == 4
