import pytest
from pyspark.sql import functions as F

from kindred.fields import align_ids
from kindred.operators import baselines as B
from kindred.operators.passes import ngrams
from kindred.operators.review import selected_scores
from kindred.plans.benchmark import blocking, held_out, in_sample, markdown
from kindred.ranking import place, running_sum
from kindred.scratch import Scratch
from kindred.skew import hot_keys, salted_join


def data(spark):
    words = ["amber", "birch", "cedar", "dune", "ember", "fjord", "grove", "heath", "inlet", "jade", "knoll", "larch"]
    left = spark.createDataFrame([(f"l{i:02}", f"{w} holdings") for i, w in enumerate(words)], "id string, n string")
    right = spark.createDataFrame([(f"r{i:02}", f"{w} holding") for i, w in enumerate(words)], "id string, n string")
    truth = spark.createDataFrame([(f"l{i:02}", f"r{i:02}") for i in range(len(words))], "left_id string, right_id string")
    return left, right, truth


def test_baselines_and_held_out(spark):
    left, right, truth = data(spark)
    rows = in_sample(left, right, truth, on=["n"], left_id="id", right_id="id")
    assert {r["method"]: r["f1"] for r in rows}["tfidf"] == 1.0 and "| tfidf |" in markdown(rows) and markdown([]) == ""
    assert blocking(left, right, truth, on=["n"], left_id="id", right_id="id", blockers=[ngrams("n", k=1)]) == {"pairs": 12, "completeness": 1.0}
    s = B.tfidf_matches(left, right, on=["n"], left_id="id", right_id="id").withColumn("p", F.col("sim")).withColumn("block", F.lit("t"))
    parts = B.entity_split(left, right, truth, on=["n"], left_id="id", right_id="id")
    assert held_out({"tfidf": s}, parts, truth)[0]["f1"] == 1.0


def test_align_and_select(spark):
    t = spark.createDataFrame([(1,), (2,)], "k long")
    got = align_ids(spark.createDataFrame([("1", "x"), (None, "y")], "k string, v string"), "k", t, "k")
    assert got.dtypes[0] == ("k", "bigint") and sorted((r.k or 0, r.v) for r in got.collect()) == [(0, "y"), (1, "x")]
    with pytest.raises(ValueError):
        align_ids(spark.createDataFrame([("3",)], "k string"), "k", t, "k")
    s = spark.createDataFrame([("a", "x", 0.5), ("b", "y", 0.4)], "left_id string, right_id string, p double")
    assert {r.left_id: r.selected for r in selected_scores(s, s.limit(1)).collect()} == {"a": True, "b": False}


def test_running_sums_span_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k").repartition(7)
    rows = running_sum(df, ["k"], F.col("k"), "s", Scratch(spark)).collect()
    assert all(r.s == r.k * (r.k + 1) // 2 for r in rows) and len(rows) == 1000
    assert sorted((r.k, r.n) for r in place(df, ["k"], "n", Scratch(spark)).collect()) == [(i, i + 1) for i in range(1000)]
    assert place(df.limit(0), ["k"], "n", Scratch(spark)).count() == 0


def test_salted_join_is_a_join(spark):
    rows = spark.range(5000).selectExpr("id as x", "case when id < 4000 then 'hot' when id < 4900 then cast(id as string) end as k")
    table = spark.createDataFrame([("hot", 1), ("4500", 2), ("none", 3)], "k string, v int")
    counts = rows.groupBy("k").count()
    hot = hot_keys(counts, ["k"], "count", 5000)
    assert [r.k for r in hot.collect()] == ["hot"]
    assert salted_join(rows, table, ["k"], hot, "x").groupBy("v").count().orderBy("v").collect() == rows.join(table, "k").groupBy("v").count().orderBy("v").collect()
