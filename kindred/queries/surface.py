"""Queries through the outer surface: files, run objects, own passes and transports, refusals, and the benchmark measures; with the SQL
that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import strptime_pattern
from kindred.operators import baselines as B
from kindred.operators.candidates import candidates
from kindred.operators.cluster import cluster
from kindred.operators.judge import HttpJudge, judge, question
from kindred.operators.passes import Pass, exact, ngrams
from kindred.operators.resolve import ordered, probability, resolve
from kindred.plans.linker import Result, load
from kindred.plans.provenance import fingerprint
from kindred.queries import core as C
from kindred.queries.oracle import SQL as CORE
from kindred.queries.oracle import _with
from kindred.scratch import Scratch
from kindred.sources.datasets import load_dataset, sample_left, validate_dataset, write_dataset
from kindred.sources.tables import read_table, write_table

# --- files


def csv_round_trip(spark, d):
    """Firms through delimited text: empty cells are missing, all else is as it was."""
    path = Scratch(spark, "csv").root + "/firms.csv"
    write_table(C._firms(spark, d).select("gvkey", "conm", "state", "city", "year"), path, single=False)
    return read_table(spark, path)


def parquet_round_trip(spark, d):
    path = Scratch(spark, "parquet").root + "/assignees.parquet"
    write_table(C._assignees(spark, d), path)
    return read_table(spark, path).select("assignee_id", "assignee", "year")


def dataset_counts(spark, d):
    """What validation says about firms, assignees and the known truth."""
    l, r = C._firms(spark, d).withColumnRenamed("gvkey", "id"), C._assignees(spark, d).withColumnRenamed("assignee_id", "id")
    return validate_dataset(l, r, C._truth(spark, d))


def dataset_round_trip(spark, d):
    folder = Scratch(spark, "dataset").root + "/set"
    l, r = C._firms(spark, d).withColumnRenamed("gvkey", "id"), C._assignees(spark, d).withColumnRenamed("assignee_id", "id")
    write_dataset(folder, l, r, C._truth(spark, d).distinct(), {"name": "firms"})
    _, right, truth, meta = load_dataset(spark, folder)
    return truth.withColumn("n_right", F.lit(meta["validation"]["n_right"])).join(right.select(F.col("id").alias("right_id"), "year"), "right_id").select("left_id", "right_id", "n_right", "year")


def left_sample(spark, d):
    """100 firms in the order of their hash, and their true pairs."""
    few, truth = sample_left(C._firms(spark, d).withColumnRenamed("gvkey", "id"), C._truth(spark, d), 100, 3)
    return few.join(truth.withColumnRenamed("left_id", "id"), "id", "left").select("id", "right_id")


def parsed_times(spark, d):
    """Loading times written day first and read by a strptime format."""
    text = F.date_format("loaded_at", "dd/MM/yyyy HH:mm")
    return C._firms(spark, d).select("gvkey", F.unix_micros(F.try_to_timestamp(text, F.lit(strptime_pattern("%d/%m/%Y %H:%M")))).alias("micros"))


def fingerprints(spark, d):
    """A fingerprint counts all rows, does not depend on their order or partitioning, and changes with any value."""
    a = C._assignees(spark, d)
    one, two = fingerprint(a), fingerprint(a.repartition(7, "city"))
    other = fingerprint(a.withColumn("year", F.when(F.col("assignee_id") == a.agg(F.min("assignee_id")).first()[0], 1).otherwise(F.col("year"))))
    return spark.createDataFrame([(one["rows"], one["sha256"] == two["sha256"], one["sha256"] == other["sha256"])], "n long, same boolean, changed_same boolean")


# --- runs


def _result(spark, d) -> Result:
    s = C._t(spark, d, "result_scores").select("left_id", "right_id", "block", "sim", probability(F.col("p")).alias("p"), "source", "error", "model", "provider", "score_origin", "answered_at")
    order = Window.partitionBy("left_id", "right_id").orderBy(F.desc_nulls_last("p"), "source", F.desc_nulls_last("answered_at"), F.coalesce("model", F.lit("")), F.coalesce("provider", F.lit("")), F.coalesce("score_origin", F.lit("")))
    one = s.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    settings = {"kindred": "x", "date": "x", "task": "link", "how": "many-to-one", "threshold": 0.5, "min_margin": None, "question": question("firm"), "on": [["conm", "assignee"]], "left_id": "gvkey", "right_id": "assignee_id"}
    settings |= {"n_left": C._firms(spark, d).count(), "n_right": C._assignees(spark, d).count()}
    return Result(resolve(one, how="many-to-one", check=False), one, settings, C._firms(spark, d), C._assignees(spark, d))


def run_candidates(spark, d):
    return _result(spark, d).candidates.select("left_id", "right_id", F.round("sim", 9).alias("sim"))


def run_relink(spark, d):
    return _result(spark, d).relink(how="one-to-many", threshold=0.6).links.select("left_id", "right_id", "p")


def run_folder(spark, d):
    """The links of a run that was saved and loaded."""
    folder = Scratch(spark, "run").root + "/run"
    _result(spark, d).save(folder)
    return load(spark, folder).links.select("left_id", "right_id", "p")


def run_merged(spark, d):
    return _result(spark, d).merged().select("left_id", "right_id", "conm", "assignee", "state_left", "state_right")


def run_facts(spark, d):
    return _result(spark, d).facts().select("topic", "item", F.round("value", 6).alias("value"))


def run_meter(spark, d):
    return _result(spark, d).meter().withColumnRenamed("count", "answers").groupBy("model").agg(F.sum("answers").alias("answers"))


def links_in_order(spark, d):
    """The first thousand links in their order."""
    return ordered(resolve(C._scores(spark, d), how="many-to-one")).limit(1000).select("left_id", "right_id", "p")


def merged_judges(spark, d):
    """Two models' scores side by side."""
    s = C._t(spark, d, "result_scores")
    by = lambda m: s.where(F.col("model") == m).groupBy("left_id", "right_id").agg(F.max(probability(F.col("p"))).alias("p"))
    return B.merge_scores(by("small-a"), by("small-b"), "_b").select("left_id", "right_id", "p", "p_b")


def questions(spark, d):
    """The propositions put to a judge."""
    rows = [("identity", question("firm")), ("definition", question(" firm ", "Subsidiaries are different.")), ("rule", question(None, "One owns the other.", "rule"))]
    return spark.createDataFrame(rows, "kind string, text string")


def judge_transport(spark, d):
    """A transport that fails on firms without a state: the error belongs to the pair, the others have their probability."""

    def ask(body: dict) -> float:
        if "state" not in body["record_a"]:
            raise ValueError("no state")
        return 0.75

    c = C._links(spark, d).withColumn("sim", F.lit(0.5)).withColumn("block", F.lit("x"))
    got = judge(c, C._firms(spark, d), C._assignees(spark, d), HttpJudge(ask, question("firm"), concurrency=4), on=[C.NAME, "state"], left_id="gvkey", right_id="assignee_id", entity="firm", budget=None)
    return got.select("left_id", "right_id", "p", "source", "error")


class Towns(Pass):
    """An own pass: firms and assignees of one state whose towns start with the same four letters."""

    name = "towns"

    def pairs(self, left: DataFrame, right: DataFrame, groups=()) -> DataFrame:
        key = lambda df, out: df.where("length(city) >= 4 and state is not null").select(F.lower(F.substring("city", 1, 4)).alias("k"), F.col("state").alias("s"), F.col("_id").alias(out))
        return key(left, "l").join(key(right, "r"), ["k", "s"]).select("l", "r")


def block_own_pass(spark, d):
    found = candidates(C._firms(spark, d), C._assignees(spark, d), on=[C.NAME], blockers=[Towns()], left_id="gvkey", right_id="assignee_id", with_sim=False)
    return found.frame.select("left_id", "right_id", "block")


class Strangers(Pass):
    name = "strangers"

    def pairs(self, left, right, groups=()):
        return left.select(F.concat(F.lit("?"), "_id").alias("l"), F.col("_id").alias("r")).limit(1)


def refusals(spark, d):
    """What is refused before any work is done, each check on the whole tables."""
    f, a, s = C._firms(spark, d), C._assignees(spark, d), C._scores(spark, d)
    block = lambda l=f, r=a, blockers=(exact(C.NAME),), **k: candidates(l, r, on=[C.NAME], blockers=list(blockers), left_id="gvkey", right_id="assignee_id", with_sim=False, **k)
    tries = {
        "more pairs than max_pairs": lambda: block(max_pairs=3),
        "repeated IDs": lambda: block(f.unionByName(f.limit(1))),
        "unknown column": lambda: block(f.drop("conm")),
        "own pass with unknown IDs": lambda: block(blockers=[Strangers()]),
        "repeated pairs": lambda: resolve(s.unionByName(s.limit(1))),
        "p out of range": lambda: resolve(s.withColumn("p", F.col("p") + 1)),
        "missing IDs": lambda: resolve(s.withColumn("left_id", F.lit(None).cast("string"))),
        "unknown rule": lambda: resolve(s, how="any"),
        "a record with itself": lambda: cluster(s.withColumn("right_id", F.col("left_id"))),
        "k below 1": lambda: ngrams("conm", k=0),
        "a rule without definition": lambda: question(None, "", "rule"),
        "nothing wrong": lambda: block(),
    }
    rows = []
    for name, attempt in tries.items():
        try:
            attempt()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "attempt string, refused boolean")


# --- benchmark measures


def abstention(spark, d):
    """Records without any true pair that were linked all the same."""
    t = C._truth(spark, d)
    left = C._firms(spark, d).join(t.select(F.col("left_id").alias("gvkey")), "gvkey", "left_anti").select(F.lit("left").alias("side"), F.col("gvkey").alias("id"))
    right = C._assignees(spark, d).join(t.select(F.col("right_id").alias("assignee_id")), "assignee_id", "left_anti").select(F.lit("right").alias("side"), F.col("assignee_id").alias("id"))
    return C._rounded(B.abstention(C._links(spark, d), left.unionByName(right)), "correct_abstention_rate")


def positive_only_metrics(spark, d):
    return C._rounded(B.pair_metrics(C._links(spark, d), C._truth(spark, d), complete=False).select("tp", "fn", "recall"), "recall")


def plain_calibration(spark, d):
    return C._rounded(B.plain_calibration(C._labels(spark, d).where("is_match <> ''").withColumn("gold", F.col("is_match") == "yes"), "gold"), "mean_p", "match_rate")


def family_choice(spark, d):
    """Blocks as variants of their first pass: the share of links stands for dev, that of judged pairs for test."""
    s = C._scores(spark, d).groupBy("block").agg(F.avg(F.coalesce((F.col("p") >= 0.5).cast("int"), F.lit(0))).alias("dev_f1"), F.avg(F.col("p").isNotNull().cast("int")).alias("test_f1"))
    runs = s.select(F.substring_index(F.substring_index("block", "+", 1), ":", 1).alias("family"), F.col("block").alias("variant"), F.round("dev_f1", 6).alias("dev_f1"), F.round("test_f1", 6).alias("test_f1"))
    return B.family_choice(runs)


_HERE = [k for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__ and not isinstance(v, type) and k not in ("queries", "oracle_sql")]

_ONE = """SELECT left_id, right_id, block, sim, CASE WHEN NOT isnan(p) THEN p END AS p, source, model, provider, score_origin FROM result_scores
  QUALIFY row_number() OVER (PARTITION BY left_id, right_id ORDER BY CASE WHEN NOT isnan(p) THEN p END DESC NULLS LAST, source, answered_at DESC NULLS LAST,
  coalesce(model, ''), coalesce(provider, ''), coalesce(score_origin, '')) = 1"""
_BEST = "SELECT * FROM one WHERE p >= 0.5 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY p DESC, sim DESC, left_id, right_id) = 1"
_RUN = f"WITH one AS ({_ONE}), lk AS ({_BEST})"
_BANDS = [("[0, 0.05]", "p <= 0.05"), ("(0.05, 0.2]", "p > 0.05 AND p <= 0.2"), ("(0.2, 0.5]", "p > 0.2 AND p <= 0.5"), ("(0.5, 0.8]", "p > 0.5 AND p <= 0.8"), ("(0.8, 0.95]", "p > 0.8 AND p <= 0.95"), ("(0.95, 1]", "p > 0.95")]
_FACTS = [
    "SELECT 'records' AS topic, 'left' AS item, CAST((SELECT count(*) FROM compustat_sample) AS DOUBLE) AS value", "SELECT 'records', 'right', (SELECT count(*) FROM patent_assignees)",
    "SELECT 'candidates', 'pairs', count(*) FROM one", "SELECT 'candidates', 'left proposed', count(DISTINCT left_id) FROM one", "SELECT 'candidates', 'right proposed', count(DISTINCT right_id) FROM one",
    "SELECT 'candidates', 'without p', count(*) FROM one WHERE p IS NULL", "SELECT 'block', coalesce(block, ''), count(*) FROM one GROUP BY 2", "SELECT 'source', coalesce(source, ''), count(*) FROM one GROUP BY 2",
    "SELECT 'links', 'links', count(*) FROM lk", "SELECT 'links', 'median p', round(median(p), 6) FROM lk", "SELECT 'links', 'left linked', count(DISTINCT left_id) FROM lk", "SELECT 'links', 'right linked', count(DISTINCT right_id) FROM lk",
    *(f"SELECT 'links', 'p in {label}', count(*) FROM lk WHERE {cond}" for label, cond in _BANDS),
]
_TRUTH = _with("t", "l")
_GREEDY = _with("s").rstrip() + """, r AS (SELECT left_id, right_id, row_number() OVER (ORDER BY p DESC, sim DESC, left_id, right_id) AS k FROM s WHERE p >= 0.5),
  g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS ls, CAST([] AS VARCHAR[]) AS rs, CAST(NULL AS VARCHAR) AS left_id, CAST(NULL AS VARCHAR) AS right_id
    UNION ALL SELECT r.k, CASE WHEN ok THEN list_append(g.ls, r.left_id) ELSE g.ls END, CASE WHEN ok THEN list_append(g.rs, r.right_id) ELSE g.rs END, CASE WHEN ok THEN r.left_id END, CASE WHEN ok THEN r.right_id END
    FROM g JOIN r ON r.k = g.k + 1, LATERAL (SELECT NOT list_contains(g.ls, r.left_id) AND NOT list_contains(g.rs, r.right_id) AS ok))
  SELECT left_id, right_id FROM g WHERE left_id IS NOT NULL"""
SQL: dict[str, str] = {
    "resolve_greedy": _GREEDY,
    "csv_round_trip": "SELECT gvkey, nullif(conm, '') AS conm, nullif(state, '') AS state, nullif(city, '') AS city, CAST(year AS VARCHAR) AS year FROM compustat_sample",
    "parquet_round_trip": "SELECT assignee_id, assignee, year FROM patent_assignees",
    "dataset_counts": _with("t") + """SELECT (SELECT count(*) FROM compustat_sample) AS n_left, (SELECT count(gvkey) - count(DISTINCT gvkey) FROM compustat_sample) AS repeated_left_ids, (SELECT count(*) FROM compustat_sample WHERE gvkey IS NULL) AS missing_left_ids,
      (SELECT count(*) FROM patent_assignees) AS n_right, (SELECT count(assignee_id) - count(DISTINCT assignee_id) FROM patent_assignees) AS repeated_right_ids, (SELECT count(*) FROM patent_assignees WHERE assignee_id IS NULL) AS missing_right_ids,
      (SELECT count(*) FROM t) AS n_truth, (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS repeated_pairs, 0 AS unknown_pairs""",
    "dataset_round_trip": _with("t") + "SELECT DISTINCT left_id, right_id, (SELECT count(*) FROM patent_assignees) AS n_right, year FROM t JOIN patent_assignees ON assignee_id = right_id",
    "left_sample": _with("t") + "SELECT id, right_id FROM (SELECT gvkey AS id FROM compustat_sample ORDER BY md5('3|' || gvkey), gvkey LIMIT 100) LEFT JOIN t ON left_id = id",
    "parsed_times": "SELECT gvkey, epoch_us(date_trunc('minute', loaded_at)) AS micros FROM compustat_sample",
    "fingerprints": "SELECT count(*) AS n, true AS same, false AS changed_same FROM patent_assignees",
    "run_candidates": f"WITH one AS ({_ONE}) SELECT left_id, right_id, round(sim, 9) AS sim FROM one",
    "run_relink": f"WITH one AS ({_ONE}) SELECT left_id, right_id, p FROM one WHERE p >= 0.6 QUALIFY row_number() OVER (PARTITION BY right_id ORDER BY p DESC, sim DESC, left_id, right_id) = 1",
    "run_folder": _RUN + " SELECT left_id, right_id, p FROM lk",
    "run_merged": _RUN + " SELECT left_id, right_id, conm, assignee, x.state AS state_left, y.state AS state_right FROM lk JOIN compustat_sample x ON x.gvkey = left_id JOIN patent_assignees y ON y.assignee_id = right_id",
    "run_facts": _RUN + " " + " UNION ALL ".join(_FACTS),
    "run_meter": f"WITH one AS ({_ONE}) SELECT model, count(*) AS answers FROM one WHERE source = 'jev' GROUP BY 1",
    "links_in_order": CORE["resolve_many_to_one"].replace("SELECT left_id, right_id, p, margin FROM mg", "SELECT left_id, right_id, p FROM mg") + " ORDER BY p DESC, left_id, right_id LIMIT 1000",
    "merged_judges": """WITH j AS (SELECT left_id, right_id, model, max(CASE WHEN NOT isnan(p) THEN p END) AS p FROM result_scores GROUP BY ALL)
      SELECT left_id, right_id, a.p, b.p AS p_b FROM (SELECT * FROM j WHERE model = 'small-a') a LEFT JOIN (SELECT * FROM j WHERE model = 'small-b') b USING (left_id, right_id)""",
    "questions": """SELECT * FROM (VALUES ('identity', 'Record A and record B refer to the same firm.'), ('definition', 'Record A and record B refer to the same firm. Subsidiaries are different.'),
      ('rule', 'Record A and record B satisfy the following match rule. One owns the other.')) v(kind, text)""",
    "judge_transport": _with("l") + r"""SELECT left_id, right_id, CASE WHEN ok THEN 0.75 END AS p, CASE WHEN ok THEN 'jev' ELSE 'error' END AS source, CASE WHEN NOT ok THEN 'no state' END AS error
      FROM (SELECT left_id, right_id, coalesce(regexp_replace(x.state, '^\s+|\s+$', '', 'g'), '') <> '' AS ok FROM l JOIN compustat_sample x ON gvkey = left_id JOIN patent_assignees ON assignee_id = right_id)""",
    "block_own_pass": "SELECT DISTINCT gvkey AS left_id, assignee_id AS right_id, 'towns' AS block FROM compustat_sample x JOIN patent_assignees y ON x.state = y.state AND lower(x.city[1:4]) = lower(y.city[1:4]) WHERE length(x.city) >= 4 AND length(y.city) >= 4",
    "refusals": "SELECT column0 AS attempt, column0 <> 'nothing wrong' AS refused FROM (VALUES ('more pairs than max_pairs'), ('repeated IDs'), ('unknown column'), ('own pass with unknown IDs'), ('repeated pairs'), ('p out of range'), ('missing IDs'), ('unknown rule'), ('a record with itself'), ('k below 1'), ('a rule without definition'), ('nothing wrong')) v(column0)",
    "abstention": _TRUTH.rstrip() + """, u AS (SELECT 'left' AS side, gvkey AS id FROM compustat_sample WHERE gvkey NOT IN (SELECT left_id FROM t) UNION ALL SELECT 'right', assignee_id FROM patent_assignees WHERE assignee_id NOT IN (SELECT right_id FROM t)),
      k AS (SELECT DISTINCT 'left' AS side, left_id AS id FROM l UNION SELECT 'right', right_id FROM l)
      SELECT side, count(*) AS records, count(k.id) AS false_linked, round(1 - count(k.id) / count(*), 6) AS correct_abstention_rate FROM u LEFT JOIN k USING (side, id) GROUP BY side""",
    "positive_only_metrics": _TRUTH.rstrip() + ", u AS (SELECT DISTINCT * FROM t), g AS (SELECT count(l.left_id) AS tp, count(*) AS n FROM u LEFT JOIN l USING (left_id, right_id)) SELECT tp, n - tp AS fn, round(tp / n, 6) AS recall FROM g",
    "plain_calibration": _with("labels") + "SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS match_rate FROM labels WHERE y IS NOT NULL GROUP BY bin",
    "family_choice": _with("s").rstrip() + """, r AS (SELECT split_part(split_part(block, '+', 1), ':', 1) AS family, block AS variant, round(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS dev_f1, round(avg(CASE WHEN p IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS test_f1 FROM s GROUP BY block),
      t AS (SELECT * FROM (SELECT *, max(dev_f1) OVER (PARTITION BY family) AS m FROM r) WHERE abs(dev_f1 - m) < 1e-9)
      SELECT family, min(variant) AS variant, arg_min(dev_f1, variant) AS dev_f1, min(test_f1) AS test_low, max(test_f1) AS test_high, count(*) AS tied FROM t GROUP BY family""",
}


def queries() -> dict:
    return {k: globals()[k] for k in _HERE}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
