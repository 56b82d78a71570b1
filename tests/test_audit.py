import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import audit as A
from kindred.operators import baselines as B


def test_allocation_and_bins(spark):
    assert A.allocation([1, 2, 15, 100], 20) == [1, 2, 9, 8]
    assert A.allocation([], 5) == [] and A.allocation([3], 0) == [0]
    df = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.0500001, 0.95, 1.0)], "p double")
    assert [r[0] for r in df.select(A.bin_of(F.col("p"))).collect()] == ["[0, 0.05]", "[0, 0.05]", "(0.05, 0.2]", "(0.8, 0.95]", "(0.95, 1]"]
    with pytest.raises(ValueError):
        A.bin_labels((0, 0.5, 0.5, 1))


def test_sample_is_stratified_and_repeatable(spark):
    rows = [(f"l{i}", f"r{i}", p) for i, p in enumerate(np.linspace(0, 1, 60).tolist())] + [("n", "n", None), ("m", "m", float("nan"))]
    s = spark.createDataFrame(rows, "left_id string, right_id string, p double")
    a, b = A.audit_sample(s, n=12, seed=1).collect(), A.audit_sample(s.orderBy("p"), n=12, seed=1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 12
    total = {}
    for r in a:
        total[r.bin] = total.get(r.bin, 0) + r.weight
    assert sum(total.values()) == pytest.approx(60)
    assert A.audit_sample(s.limit(0), n=5).count() == 0


def labels(spark, rows):
    return spark.createDataFrame([(str(i), str(i), *r) for i, r in enumerate(rows)], "left_id string, right_id string, p double, is_match string, weight double, bin string, selected string")


def test_metrics_by_hand(spark):
    rows = [(0.9, "yes", 5.0, "high", "1"), (0.8, "0", 1.0, "high", "0"), (0.4, "y", 2.0, "low", "0"), (0.1, "no", 4.0, "low", "0"), (0.2, "", 6.0, "low", "0")]
    df = labels(spark, rows)
    m = A.metrics(df).first()
    # the low bin's labels stand for 12 of weight, twice their own
    assert (m.precision, m.recall, m.f1) == (pytest.approx(5 / 6), pytest.approx(5 / 9), pytest.approx(10 / 15))
    assert (m.n_labeled, m.n_unlabeled) == (4, 1)
    assert A.metrics(df, mode="selected").first().precision == 1.0
    c = {r.bin: r for r in A.calibration(df).collect()}
    assert c["low"].n == 2 and c["low"].mean_p == pytest.approx((0.4 * 2 + 0.1 * 4) / 6) and c["high"].match_rate == pytest.approx(5 / 6)
    assert A.metrics(labels(spark, [*rows, (0.5, None, 1.0, "mid", "0")])).first().precision is None
    e = A.evaluate(df, n_boot=100)
    assert e.precision[0] == pytest.approx(5 / 6) and e.recall[1] <= e.recall[0] <= e.recall[2]
    assert "F1" in e.summary() and "| precision |" in e.to_markdown()
    with pytest.raises(ValueError):
        A.evaluate(labels(spark, [(0.5, "perhaps", 1.0, "x", "1")]))


def pairs(spark, rows):
    return spark.createDataFrame(rows, "left_id string, right_id string")


def test_truth(spark):
    l, t, c = pairs(spark, [("a", "x"), ("b", "y")]), pairs(spark, [("a", "x"), ("c", "z")]), pairs(spark, [("a", "x"), ("c", "z"), ("q", "q")])
    r = A.score_against_truth(l, t, c).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1, r.pairs_completeness) == (1, 1, 1, 0.5, 0.5, 0.5, 1.0)
    assert A.score_against_truth(l.limit(0), t.limit(0)).first().f1 is None and A.score_against_truth(l.limit(0), t.limit(0), empty=0.0).first().f1 == 0.0
    s = B.stage_metrics(c, l, t).first()
    assert (s.blocking_recall, s.conditional_recall, s.final_recall) == (1.0, 0.5, 0.5)
    assert {(r.kind, r.left_id) for r in B.diagnose(c.where("left_id <> 'c'"), l, t).collect()} == {("retrieval_miss", "c"), ("false_positive", "b")}


def test_threshold_by_exhaustion(spark):
    rng = np.random.default_rng(3)
    s = [(f"l{i}", "r", float(x)) for i, x in enumerate(rng.integers(0, 6, 30) / 5)]
    true = {x[0] for x in s if rng.random() < x[2]}
    t = pairs(spark, [(a, "r") for a in true] + [("z", "z")])
    got = B.tune_threshold(spark.createDataFrame(s, "left_id string, right_id string, sim double"), t).first()
    best = max(((2 * sum(a in true for a, _, v in s if v >= c) / (sum(v >= c for *_, v in s) + len(true) + 1), -sum(v >= c for *_, v in s)) for c in {v for *_, v in s}))
    assert (got.f1, -got.links) == (pytest.approx(best[0]), best[1])


def test_ecm_recovers_agreement():
    rng = np.random.default_rng(0)
    m = rng.random(4000) < 0.2
    g = np.where(m[:, None], rng.random((4000, 3)) < 0.9, rng.random((4000, 3)) < 0.1).astype(int)
    rows, n = np.unique(g, axis=0, return_counts=True)
    share, mm, u = B.ecm([(*map(int, r), int(k)) for r, k in zip(rows, n)])
    assert share == pytest.approx(0.2, abs=0.04) and min(mm) > 0.8 and max(u) < 0.2
    with pytest.raises(ValueError):
        B.ecm([(1, 0, 5), (1, 1, 5)])


def test_entity_split_keeps_entities_together(spark):
    l = spark.createDataFrame([(f"l{i}", f"n{i // 2}") for i in range(20)], "id string, n string")
    r = spark.createDataFrame([(f"r{i}", f"m{i}") for i in range(10)], "id string, n string")
    t = pairs(spark, [(f"l{2 * i}", f"r{i}") for i in range(10)])
    rows = B.entity_split(l, r, t, on=["n"], left_id="id", right_id="id").collect()
    part = {(x.side, x.id): x.part for x in rows}
    assert sum(p == "dev" for (s, _), p in part.items() if s == "right") == 3
    assert all(part["left", f"l{2 * i}"] == part["left", f"l{2 * i + 1}"] == part["right", f"r{i}"] for i in range(10))


def test_agreement_names_and_negatives(spark):
    mk = lambda rows: spark.createDataFrame(rows, "left_id string, right_id string, p double")
    a, b = mk([("1", "x", 0.9), ("2", "x", 0.8), ("3", "x", 0.1), ("4", "x", float("nan"))]), mk([("1", "x", 0.7), ("2", "x", 0.2), ("3", "x", 0.1)])
    r = B.judge_agreement(a, b).first()
    assert (r.both_yes, r.only_a, r.both_no, r.spearman) == (1, 1, 1, pytest.approx(1.0)) and r.kappa == pytest.approx(0.4)
    n = spark.createDataFrame([("k", "B"), ("k", "A"), ("k", "B"), (None, "C"), ("j", "y"), ("j", "x")], "k string, n string")
    assert {x.k: (x.canonical, x.aliases) for x in B.canonical_names(n, "k", "n").collect()} == {"k": ("B", "A | B"), "j": ("x", "x | y")}
    s = spark.createDataFrame([("a", "t", 0.9), ("a", "u", 0.8), ("a", "v", 0.8), ("b", "u", 0.9)], "left_id string, right_id string, sim double")
    assert [(x.right_id, x["rank"]) for x in B.hardest_negatives(s, pairs(spark, [("a", "t")]), 1).collect()] == [("u", 1)]


def test_more_labels_than_the_driver_takes(spark):
    rng = np.random.default_rng(1)
    rows = [(float(p), "yes" if rng.random() < p else "no", 1.0 + i % 7 * even, "low" if p < 0.5 else "high", f"{i}") for even in (0, 1) for i, p in enumerate(rng.random(400).tolist())]
    df = spark.createDataFrame([(*r[:4], f"{i}", f"{i}") for i, r in enumerate(rows)], "p double, is_match string, weight double, bin string, left_id string, right_id string")
    near, far = A.evaluate(df, n_boot=400), A.evaluate(df.repartition(7), n_boot=400, most=100)
    assert far.n_labeled == 800 and not far.notes
    for name in ("precision", "recall", "f1"):
        assert np.allclose(getattr(near, name), getattr(far, name), atol=0.012)
    small, again = (A.wide_bootstrap(d, 0.5, "threshold", 50, 3, chunk=40) for d in (df, df.orderBy("p")))
    assert np.allclose(small, again, atol=1e-9) and small.shape == (50, 3) and small.std(0).min() > 0.003
