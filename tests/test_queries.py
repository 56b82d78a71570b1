import __spark_entry__ as entry


def test_names_and_oracles():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 70 and set(o) <= set(q)
    assert all(callable(f) for f in q.values())


def test_exact_stream(spark, tmp_path):
    from kindred.streaming import exact_stream

    spark.createDataFrame([("1", "Acme & Co"), ("2", None)], "id string, name string").write.parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([(7, "ACME and co"), (8, "")], "k long, firm string")
    stream = spark.readStream.schema("id string, name string").parquet(str(tmp_path / "in"))
    q = exact_stream(stream, table, [("name", "firm")], "id", "k").writeStream.format("memory").queryName("met").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select * from met").collect()] == [("1", 7)]


def test_flagship(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data here")
    df = entry.entry(spark)
    assert df.columns == ["left_id", "right_id", "block", "sim", "p", "margin"] and df.count() > 0
