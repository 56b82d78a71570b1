import random
import re

import pytest
from pyspark.sql import functions as F

from kindred.llm.copies import copies, letters_digits, line_fields
from kindred.llm.groups import components, group_ids
from kindred.llm.topn import ranked_pairs, top_n


def union_find(edges):
    head = {}

    def root(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        head[b] = a
    return {x: root(x) for x in list(head)}


def test_components_chain_star_and_random(spark):
    rng = random.Random(1)
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("hub", f"s{i}") for i in range(60)] + [(f"x{rng.randrange(80)}", f"x{rng.randrange(80)}") for _ in range(60)]
    df = spark.createDataFrame(edges + edges[:5] + [(b, a) for a, b in edges[:5]] + [(None, "q")], "a string, b string")
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    want = {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}
    assert got == want
    assert components(df.limit(0), "a", "b").count() == 0


def test_plans_of_components_stay_small_and_hubs_are_salted(spark):
    edges = spark.range(3000).selectExpr("'hub' AS a", "concat('s', id) AS b").unionByName(spark.range(40).selectExpr("concat('t', id) AS a", "concat('t', id + 1) AS b"))
    found = components(edges, "a", "b")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 2  # each plan is held by the driver
    assert {r.root: r["count"] for r in found.groupBy("root").count().collect()} == {"hub": 3001, "t0": 41}
    from kindred.skew import lookup_counted

    table = edges.select("a").distinct().withColumn("v", F.length("a"))
    met = lookup_counted(edges, table, "a", "b")
    assert "_salt" in met._jdf.queryExecution().analyzed().toString()
    assert met.exceptAll(edges.join(table, "a")).isEmpty() and met.count() == 3040


def test_loops_of_components_count_rows_once(spark):
    from kindred.scratch import Scratch

    edges = Scratch(spark).cut(spark.range(40).selectExpr("concat('t', id) AS a", "concat('t', id + 1) AS b"))
    tables = Scratch(spark)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    components(edges, "a", "b", tables).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    # a table takes a write, and a count or a look whether anything is left
    assert store.executionsCount() - before <= 2 * tables._n + 2


def test_group_ids(spark):
    s = spark.createDataFrame([("1", "A", 0.5, "x"), ("1", "A", float("nan"), "x"), ("2", "A", 0.4, "x"), ("2", "B", None, "x"), ("3", "C", float("nan"), "x"), (None, "D", 0.9, "x")], "left_id string, right_id string, p double, cluster_id string")
    m = spark.createDataFrame([("A", 7, 1), ("E", 7, 2), ("E", 7, 2), ("F", 8, 3), ("G", None, 4), (None, 7, 5)], "id string, cluster_id long, p long")
    rows = group_ids(s, "left_id", "right_id", "p", 0.5, m, "id", "cluster_id").collect()
    assert {r.id: r.group_id for r in rows} == {"1": "1", "A": "1", "E": "1", "2": "2", "B": "B", "3": "3", "C": "C", "D": "D", "F": "F", "G": "G"} and len(rows) == 10
    assert group_ids(s.limit(0), "left_id", "right_id", "p", 0.5, m.limit(0), "id", "cluster_id").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_top_n_against_sorting(spark, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        for i in range(rng.choice([1, 2, 5, 400 if g == 0 else 30])):
            tail = rng.choice(["", "x" * rng.randrange(60)])
            rows.append((f"g{g}", f"i{rng.randrange(10**6):06}{tail}", rng.choice([0.5, 0.5, rng.random(), -1.0, float("inf")]), rng.choice([None, float("nan"), 0.1, 0.1, 0.2]), 3, i))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows + [(None, "a", 1.0, 1.0, 3, 0), ("g1", None, 1.0, 1.0, 3, 0), ("none", "a", 1.0, 1.0, 0, 0)], "g string, i string, p double, s double, n int, extra int")
    got = {}
    for r in top_n(df, ["g"], "i", ["p", "s"], "n").collect():
        got.setdefault(r.g, set()).add(r.i)
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-min(r[2], 1.79e308), -(r[3] if r[3] is not None and r[3] == r[3] else -9e99), r[1].encode()))
        want[g] = {r[1] for r in mine[:3]}
    assert got == want
    assert top_n(df.limit(0), ["g"], "i", ["p"], "n").count() == 0


def test_top_n_identifiers_alike_beyond_their_codes(spark):
    ids = ["z" * 70 + f"{i:02}" for i in range(9)]
    df = spark.createDataFrame([("g", i, 0.5, 2) for i in ids], "g string, i string, p double, n int")
    assert sorted(r.i for r in top_n(df, ["g"], "i", ["p"], "n").collect()) == ids[:2]


def test_ranked_pairs_take_the_highest_number(spark):
    df = spark.createDataFrame([("a", "x", 0.2, 0.5), ("a", "x", 0.9, 0.5), ("a", "x", float("nan"), 0.5), ("a", "y", None, 0.5)], "l string, r string, p double, sim double")
    assert [(r.group_id, r.item_id, r.p) for r in ranked_pairs(df, "scores", "l", "r", 3).collect()] == [("a", "x", 0.9)]


def canon(x):
    return None if x is None else re.sub(r"[^\w]|_", "", x).upper().lower()


@pytest.mark.parametrize("bits", [1 << 29, 4096])
def test_copies_against_grouping(spark, bits):
    rng = random.Random(7)
    names = ["Acme Corp", "ACME-CORP.", " acme corp", "Acme Crop", None, "", "!!", "Straße", "STRASSE", "é", "e"]
    rows = [(f"k{i:04}", rng.choice(names), rng.choice([None, "NY", "n.y.", ""])) for i in range(900)] + [(f"u{i}", f"only {i}", None) for i in range(400)] + [(None, "Acme Corp", None), ("k0000", "Acme Corp", None)]
    df = spark.createDataFrame(rows, "id string, n string, s string").repartition(5)
    cols = [letters_digits(F.col("n")), letters_digits(F.col("s"))]
    got = {(r.row_id, r.first_id) for r in copies(df, "id", cols, where=cols[0] != "", max_bits=bits).collect()}
    sets = {}
    for i, n, s in rows:
        if i is not None and canon(n):
            sets.setdefault((canon(n), canon(s)), set()).add(i)
    assert got == {(i, min(v)) for v in sets.values() if len(v) > 1 for i in v}
    assert copies(df.limit(0), "id", cols).count() == 0


def test_lines(spark):
    lines = ["COL conm VAL Acme Corp COL state VAL NY", "COL state VAL  n.y. COL conm VAL ACME, corp", '{"state": "NY", "conm": "acme corp", "city": ""}', "COL assignee VAL Acme Corp COL state VAL NY", "plain text", None, '{"a": "1"} rest']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "line string").select(line_fields(F.col("line"))).collect()]
    assert got[0] == got[1] == got[2] != got[3] and got[4] == "plaintext" and got[5] is None
