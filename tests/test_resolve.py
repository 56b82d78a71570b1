import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kindred.operators.candidates import candidates
from kindred.operators.cluster import average_linkage, cluster
from kindred.operators.components import connected_components
from kindred.operators.judge import states
from kindred.operators.passes import exact, ngrams
from kindred.operators.resolve import _greedy, match_component, resolve, with_margin
from kindred.operators.review import apply_decisions, check_history, review_queue

SCHEMA = "left_id string, right_id string, block string, sim double, p double"


def scores(spark, rows):
    return spark.createDataFrame([(a, b, "x", s, p) for a, b, p, s in rows], SCHEMA)


def linked(df):
    return sorted((r.left_id, r.right_id) for r in df.collect())


def brute(edges):
    order = sorted(range(len(edges)), key=lambda i: edges[i][:2])
    best = None
    for n in range(len(edges) + 1):
        for c in itertools.combinations(range(len(edges)), n):
            if len({edges[i][0] for i in c}) == len({edges[i][1] for i in c}) == n:
                k = (sum(Fraction(edges[i][2]) for i in c), sum(Fraction(edges[i][3]) for i in c), tuple(i in c for i in order))
                if best is None or k > best[0]:
                    best = (k, sorted(c))
    return best[1]


def test_assignment_against_brute_force():
    rng = random.Random(5)
    for _ in range(250):
        e = [(f"l{a}", f"r{b}", rng.choice([0.0, 0.5, 0.5, 1.0, rng.random()]), rng.choice([0.0, 0.5, 1.0])) for a in range(3) for b in range(3) if rng.random() < 0.8]
        if e:
            assert sorted(match_component(e)) == brute(e)


def test_cardinalities(spark):
    s = scores(spark, [("a", "x", 0.9, 0.5), ("a", "y", 0.8, 0.5), ("b", "x", 0.8, 0.5), ("b", "y", 0.1, 0.5), ("c", "z", None, 0.5), ("d", "z", float("nan"), 0.5)])
    assert linked(resolve(s, how="many-to-many")) == [("a", "x"), ("a", "y"), ("b", "x")]
    assert linked(resolve(s, how="many-to-one")) == [("a", "x"), ("b", "x")]
    assert linked(resolve(s, how="one-to-many")) == [("a", "x"), ("a", "y")]
    assert linked(resolve(s, how="one-to-one")) == [("a", "y"), ("b", "x")]
    assert linked(resolve(s, how="one-to-one", min_margin=0.0)) == []
    assert linked(resolve(s.limit(0))) == []
    with pytest.raises(ValueError):
        resolve(s, how="any")


def test_margin_by_definition(spark):
    rng = random.Random(2)
    rows = [(f"l{a}", f"r{b}", rng.choice([None, 0.2, 0.5, 0.5, 0.9]), 0.1) for a in range(4) for b in range(4) if rng.random() < 0.8]
    got = {(r.left_id, r.right_id): r.margin for r in with_margin(scores(spark, rows)).collect()}
    for i, (a, b, p, _) in enumerate(rows):
        others = [q for j, (c, d, q, _) in enumerate(rows) if j != i and (c == a or d == b) and q is not None]
        want = None if p is None or not others else p - max(others)
        assert got[a, b] == (want if want is None else pytest.approx(want))


def test_greedy_rounds_equal_one_by_one(spark):
    from kindred.operators.resolve import greedy_matching
    from kindred.scratch import Scratch

    rng = random.Random(9)
    e = [(f"l{a}", f"r{b}", rng.choice([0.5, 0.7, 0.9]), rng.choice([0.1, 0.2])) for a in range(6) for b in range(6) if rng.random() < 0.6]
    assert linked(greedy_matching(scores(spark, e), Scratch(spark))) == sorted(e[i][:2] for i in _greedy(e))


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    n = spark.createDataFrame([(500,), (None,)], "n long")
    got = {r.node: r.component for r in connected_components(e, "a", "b", e.selectExpr("a as n").union(e.selectExpr("b")).union(n), "n").collect()}
    assert got[40] == 0 and got[101] == 100 and got[500] == 500 and len(got) == 44
    assert connected_components(e.limit(0), "a", "b").count() == 0


def slow_linkage(pairs, ids, bar, count):
    known = {frozenset(x[:2]): x[2] for x in pairs}
    groups = [{i} for i in sorted(ids)]
    while True:
        best = None
        for x, y in itertools.combinations(sorted(groups, key=min), 2):
            ps = [known.get(frozenset((a, b)), 0 if count else "none") for a in x for b in y]
            judged = [known[frozenset((a, b))] for a in x for b in y if known.get(frozenset((a, b))) is not None]
            votes = [Fraction(p) for p in ps if p is not None and p != "none"]
            if judged and votes:
                mean = sum(votes) / len(votes)
                if mean >= Fraction(bar) and (best is None or mean > best[0]):
                    best = (mean, x, y)
        if best is None:
            return {i: min(g) for g in groups for i in g}
        groups = [g for g in groups if g not in best[1:]] + [best[1] | best[2]]


@pytest.mark.parametrize("count", [True, False])
def test_average_linkage_by_definition(count):
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(2, 6)
        pairs = [(a, b, rng.choice([None, 0.1, 0.5, 0.5, 0.9, 1.0])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.8]
        if pairs:
            ids = {i for p in pairs for i in p[:2]}
            assert average_linkage(pairs, 0.5, count) == slow_linkage(pairs, ids, 0.5, count)


def test_cluster_bad_edge_and_ids(spark):
    good = [(f"{g}{i}", f"{g}{j}", 0.95, 0.0) for g in "ab" for i, j in ((1, 2), (1, 3), (2, 3))]
    rows = [*good, ("a1", "b1", 0.6, 0.0)] + [(f"a{i}", f"b{j}", 0.05, 0.0) for i in (1, 2, 3) for j in (1, 2, 3) if (i, j) != (1, 1)]
    s = scores(spark, rows)
    ids = spark.createDataFrame([(x,) for x in ("a1", "a2", "a3", "alone", "b1", "b2", "b3")], "id string")
    avg = {r.id: (r.cluster_id, r.cluster_size) for r in cluster(s, ids=ids, id="id").collect()}
    assert avg == {"a1": (0, 3), "a2": (0, 3), "a3": (0, 3), "alone": (1, 1), "b1": (2, 3), "b2": (2, 3), "b3": (2, 3)}
    assert cluster(s, ids=ids, id="id", linkage="components").select("cluster_id").distinct().count() == 2
    with pytest.raises(ValueError):
        cluster(scores(spark, [("a", "a", 0.5, 0.0)]), check=True)


def test_review(spark):
    s = scores(spark, [("a", "x", 0.9, 0.5), ("a", "y", 0.85, 0.5), ("b", "y", 0.7, 0.5), ("c", "y", None, 0.5)])
    d = spark.createDataFrame([("a", "y", "accept"), ("c", "y", "unsure")], "left_id string, right_id string, decision string")
    rows = apply_decisions(s, d, how="one-to-one", original=s.limit(1)).collect()
    assert [(r.left_id, r.right_id, r.selection_basis) for r in rows] == [("a", "y", "manual_accept")]
    clash = spark.createDataFrame([("a", "y", "accept"), ("b", "y", "accept")], "left_id string, right_id string, decision string")
    with pytest.raises(ValueError, match="conflicting"):
        apply_decisions(s, clash, how="one-to-one")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "id string")
    q = {r.id: (r.priority, r.candidates) for r in review_queue(ids, "id", s, s.where("left_id = 'b'"), "left_id").collect()}
    assert q == {"a": (0, 2), "b": (3, 1), "c": (1, 1), "z": (1, 0)}


def test_history_chains():
    e = lambda i, prev, **k: {"event_id": i, "previous_event": prev, "left_id": "a", "right_id": "x", "decision": "accept", "reviewer": "me", "timestamp": "t", "note": ""} | k
    assert check_history([e("2", "1", decision="reject"), e("1", None)])["a", "x"]["decision"] == "reject"
    for bad in ([e("1", None), e("2", None)], [e("2", "1")], [e("1", None, decision="maybe")], [e("1", None), e("1", "1")]):
        with pytest.raises(ValueError):
            check_history(bad)


@pytest.mark.parametrize("count", [True, False])
def test_linkage_by_rounds_equals_one_by_one(spark, count):
    from pyspark.sql import functions as F

    from kindred.operators.cluster import linkage_rounds
    from kindred.scratch import Scratch

    rng = random.Random(7)
    pairs = [(f"{g}{a}", f"{g}{b}", rng.choice([None, 0.1, 0.5, 0.75, 0.9, 1.0])) for g in "xy" for a, b in itertools.combinations(range(4), 2)]
    df = spark.createDataFrame(pairs, "left_id string, right_id string, p double").withColumn("component", F.substring("left_id", 1, 1))
    got = {r.id: r.cluster for r in linkage_rounds(df, 0.5, count, Scratch(spark)).collect()}
    assert got == average_linkage(pairs, 0.5, count)


def test_large_component_is_solved_exactly():
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(1900), rng.randrange(1900)) for _ in range(100_000)})
    e = [(a, b, rng.uniform(0.5, 1), rng.random()) for a, b in pairs]
    from kindred.operators.assignment import Assignment, _whole_weights

    made = Assignment(e, _whole_weights(e))
    best = made.earliest()
    # prices that cover every pair prove that no matching weighs more
    assert all(made.up[a] + made.down[b] >= w for (a, b, *_), w in zip(e, made.weights))
    assert sum(made.weights[i] for i in best) == sum(made.up.values()) + sum(made.down.values())
    assert len({e[i][0] for i in best}) == len({e[i][1] for i in best}) == len(best)


def sources(df):
    """How often the optimized plan reads a table."""
    return str(df._jdf.queryExecution().optimizedPlan().toString()).count("Relation [")


def test_plans_stay_small(spark, tmp_path):
    scores(spark, [("a", "x", 0.9, 0.5), ("a", "y", 0.8, 0.5), ("b", "x", 0.7, 0.5)]).write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    s = s.groupBy("left_id", "right_id").agg(*[F.max(c).alias(c) for c in ("block", "sim", "p")])
    d = spark.createDataFrame([("b", "x", "accept")], "left_id string, right_id string, decision string")
    assert sources(with_margin(s)) <= 8
    got = apply_decisions(s, d, how="many-to-one", original=s.select("left_id", "right_id"))
    assert sources(got) <= 24 and linked(got) == [("a", "x"), ("b", "x")]
    assert with_margin(s.withColumn("none", F.lit(None))).columns == [*s.columns, "none", "margin"]


def test_plans_of_pairs_stay_small(spark, tmp_path):
    scores(spark, [("a", "x", 0.9, 0.5), ("b", "x", 0.7, 0.5)]).write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s")).groupBy("left_id", "right_id").agg(F.max("sim").alias("sim"))
    left = spark.createDataFrame([("a", "Acme"), ("b", "Best")], "i string, n string")
    right = spark.createDataFrame([("x", "Acme"), ("y", "Beta")], "j string, n string")
    c = candidates(left, right, on=["n"], blockers=[exact("n"), ngrams("n", k=1)], left_id="i", right_id="j").frame
    assert sources(c) <= 24 and ("a", "x") in linked(c)
    asked = states(s, left, right, ["n"], "i", "j", "?")
    assert sources(asked) <= 2 and len(asked.collect()) == 2
