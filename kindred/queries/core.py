"""Queries over the record-linkage tables, one for each operator, each over whole tables.

Firms (compustat_sample) are the left side and assignees (patent_assignees) the right one; the scores, links and clusters of the saved
run feed the operators that start from scores. The SQL that states the same results is in oracle.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.fields import align_ids
from kindred.functions.text import acronym_keys, clean, guard_formula, jaro_winkler, key_text, normalize, record_text, text_grams, word_grams
from kindred.operators import audit as A
from kindred.operators import baselines as B
from kindred.operators.candidates import all_left, candidates, pair_similarity, pairs_completeness, self_candidates, union_candidates, unproposed
from kindred.operators.cluster import cluster, cluster_links, labeled, split_pairs
from kindred.operators.components import connected_components
from kindred.operators.judge import ColumnJudge, judge, pair_tokens, question, states, todo
from kindred.operators.passes import embeddings, exact, initials, ngrams, window, within
from kindred.operators.resolve import greedy_matching, probability, resolve, with_margin
from kindred.operators.review import apply_decisions, latest, review_queue, selected_scores
from kindred.operators.vectors import gram_weights
from kindred.plans.linker import merged
from kindred.queries.oracle import SQL
from kindred.scratch import Scratch
from kindred.sources.lines import parse_record

NAME = ("conm", "assignee")
PLACE = ("state", "city")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _firms(spark, d):
    return _t(spark, d, "compustat_sample")


def _assignees(spark, d):
    return _t(spark, d, "patent_assignees")


def _sides(spark, d):
    return _firms(spark, d).withColumn("_id", F.col("gvkey")), _assignees(spark, d).withColumn("_id", F.col("assignee_id"))


def _scores(spark, d) -> DataFrame:
    """The saved scores with each pair once: the best number, NaN and null as missing."""
    s = _t(spark, d, "result_scores")
    return s.groupBy("left_id", "right_id").agg(F.min("block").alias("block"), F.max("sim").alias("sim"), F.max(probability(F.col("p"))).alias("p"))


def _links(spark, d) -> DataFrame:
    return _t(spark, d, "result_links").select("left_id", "right_id").distinct()


def _clusters(spark, d) -> DataFrame:
    """The later run's clusters, each assignee once."""
    c = _t(spark, d, "dedupe_clusters").groupBy("id").agg(F.min("cluster_id").alias("cluster_id"))
    n = c.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return c.join(n, "cluster_id").select("id", "cluster_id", "cluster_size")


def _truth(spark, d) -> DataFrame:
    """Pairs of equal plain names in one state and city: a known truth for measuring."""
    l, r = _sides(spark, d)
    return exact(NAME, "state", "city").pairs(l, r).withColumnsRenamed({"l": "left_id", "r": "right_id"})


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("l").alias("left_id"), F.col("r").alias("right_id"))


# --- text


def normalize_names(spark, d):
    return _assignees(spark, d).select("assignee_id", normalize("assignee").alias("name"))


def normalize_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(normalize("text")).alias("text_md5"))


def clean_values(spark, d):
    f = _firms(spark, d).withColumn("founded", F.col("year").cast("double"))
    return f.select("gvkey", clean(f, "conm").alias("conm"), clean(f, "state").alias("state"), clean(f, "founded").alias("founded"))


def key_text_firms(spark, d):
    f = _firms(spark, d).withColumn("founded", F.col("year").cast("double")).withColumn("decimal", F.concat(F.col("year").cast("string"), F.lit(".0")))
    return f.select("gvkey", key_text(f, "conm").alias("name_key"), key_text(f, "founded").alias("double_key"), key_text(f, "decimal").alias("text_key"), key_text(f, "year").alias("int_key"))


def record_text_firms(spark, d):
    return _firms(spark, d).select("gvkey", record_text(["conm", "state", "city"]).alias("text"))


def acronyms(spark, d):
    a, x = acronym_keys(normalize("conm"))
    return _firms(spark, d).select("gvkey", a.alias("acronym"), x.alias("expansion"))


def word_ngrams(spark, d):
    g = _firms(spark, d).select("gvkey", F.explode(word_grams(normalize("conm"), 2, 4)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gvkey").alias("firms"))


def text_ngrams(spark, d):
    return _firms(spark, d).select("gvkey", normalize("conm").alias("t")).select("gvkey", F.explode(text_grams(F.col("t"), 3, 3)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def tfidf_weights(spark, d):
    l, r = _sides(spark, d)
    lw, _ = gram_weights(l.select(F.col("_id").alias("id"), record_text(["conm"]).alias("text")), r.select(F.col("_id").alias("id"), record_text(["assignee"]).alias("text")), 2, 4)
    return lw.select("text", "gram", F.round("w", 6).alias("w"))


def name_similarity(spark, d):
    """Jaro-Winkler of the names of all scored pairs."""
    p = _t(spark, d, "result_scores").select("left_id", "right_id").distinct()
    m = p.join(_firms(spark, d).select(F.col("gvkey").alias("left_id"), normalize("conm").alias("a")), "left_id").join(_assignees(spark, d).select(F.col("assignee_id").alias("right_id"), normalize("assignee").alias("b")), "right_id")
    return m.select("left_id", "right_id", F.round(jaro_winkler(F.col("a"), F.col("b")), 6).alias("jw"))


def guarded_cells(spark, d):
    return _assignees(spark, d).select("assignee_id", guard_formula(F.col("assignee")).alias("cell"))


def parsed_lines(spark, d):
    f = parse_record(F.col("line"))
    return _t(spark, d, "record_lines").select("line_id", f["conm"].alias("conm"), f["assignee"].alias("assignee"), f["state"].alias("state"), f["city"].alias("city"), f["year"].alias("year"))


# --- blocking


def block_exact(spark, d):
    return _ids(exact(NAME).pairs(*_sides(spark, d)))


def block_exact_fields(spark, d):
    return _ids(exact(NAME, *PLACE, "year").pairs(*_sides(spark, d)))


def block_initials(spark, d):
    return _ids(initials(NAME).pairs(*_sides(spark, d)))


def block_ngrams(spark, d):
    return _ids(ngrams(NAME, k=10).pairs(*_sides(spark, d)))


def block_ngrams_reverse(spark, d):
    return _ids(ngrams(NAME, k=10, reverse=True).pairs(*_sides(spark, d)))


def block_ngrams_fields(spark, d):
    return _ids(ngrams(NAME, "city", k=5, min_sim=0.3).pairs(*_sides(spark, d)))


def block_ngrams_padded(spark, d):
    return _ids(ngrams("city", k=3, min_sim=0.0).pairs(*_sides(spark, d)))


def block_window_year(spark, d):
    return _ids(within(window("year", 2), "city").pairs(*_sides(spark, d)))


def block_window_days(spark, d):
    return _ids(within(window("loaded_at", between=(0, 3), unit="days"), "state").pairs(*_sides(spark, d)))


def block_window_events(spark, d):
    """Sign-ups and purchases of all users where the purchase follows within an hour."""
    e = _t(spark, d, "events")
    l, r = (e.where(F.col("event_type") == t).withColumn("_id", F.col("event_id")) for t in ("purchase", "signup"))
    return _ids(within(window("ts", between=(0, 60), unit="minutes"), "user_id").pairs(l, r))


def block_window_balance(spark, d):
    l = _t(spark, d, "customer").withColumn("_id", F.col("c_custkey"))
    r = _t(spark, d, "supplier").withColumn("_id", F.col("s_suppkey"))
    return _ids(within(window(("c_acctbal", "s_acctbal"), 25.0), ("c_nationkey", "s_nationkey")).pairs(l, r))


def window_dropped(spark, d):
    """What a date window on free text loses: the feed's name is no date."""
    docs = _t(spark, d, "documents")
    w = window(("source", "published"), 1, unit="days")
    lost = w.dropped(docs.withColumn("_id", F.col("doc_id")), docs.withColumn("_id", F.col("doc_id")))
    rows = [(side, lost[side]["column"], lost[side]["missing"], lost[side]["unparseable"]) for side in ("left", "right")]
    return spark.createDataFrame(rows, "side string, column_name string, missing long, unparseable long")


def block_within_exact(spark, d):
    return _ids(within(exact(NAME), "state").pairs(*_sides(spark, d)))


def block_within_match(spark, d):
    return _ids(within(exact(NAME), "state", missing="match").pairs(*_sides(spark, d)))


def block_within_ngrams(spark, d):
    return _ids(within(ngrams(NAME, k=3), "city").pairs(*_sides(spark, d)))


def block_embeddings(spark, d):
    v = _t(spark, d, "embeddings").withColumn("_id", F.col("vec_id"))
    return _ids(embeddings("embedding", k=5).pairs(v, v))


def block_embeddings_reverse(spark, d):
    v = _t(spark, d, "embeddings").withColumn("_id", F.col("vec_id"))
    return _ids(within(embeddings("embedding", k=3, min_sim=0.2, reverse=True), "label").pairs(v, v))


def _two_passes(spark, d):
    return candidates(_firms(spark, d), _assignees(spark, d), on=[NAME, "city"], blockers=[exact(NAME), within(window("year", 1), "city"), exact("city", "state", "year")], left_id="gvkey", right_id="assignee_id")


def candidates_union(spark, d):
    return _two_passes(spark, d).frame.select("left_id", "right_id", "block", F.round("sim", 6).alias("sim"))


def blocking_diagnostics(spark, d):
    return _two_passes(spark, d).diagnostics()


def pair_similarities(spark, d):
    l, r = _sides(spark, d)
    pairs = _t(spark, d, "result_links").select(F.col("left_id").alias("l"), F.col("right_id").alias("r")).distinct()
    return pair_similarity(pairs, l, r, ["conm", "state"], ["assignee", "state"]).select(F.col("l").alias("left_id"), F.col("r").alias("right_id"), F.round("sim", 6).alias("sim"))


def dedupe_candidates(spark, d):
    return self_candidates(_assignees(spark, d), on=["assignee"], blockers=[exact("assignee"), within(window("year", 1), "city")], id="assignee_id", with_sim=False).frame


def default_candidates(spark, d):
    """Both n-gram directions on names and cities of one state."""
    passes = [within(ngrams(NAME, k=2), "state", "year"), within(ngrams(NAME, k=2, reverse=True), "state", "year")]
    return candidates(_firms(spark, d), _assignees(spark, d), on=[NAME], blockers=passes, left_id="gvkey", right_id="assignee_id", with_sim=False).frame


def completeness(spark, d):
    return pairs_completeness(_scores(spark, d), _truth(spark, d)).select(F.round("pairs_completeness", 9).alias("pairs_completeness"))


def completeness_unordered(spark, d):
    c = _clusters(spark, d)
    together = c.withColumnRenamed("id", "left_id").join(c.select(F.col("id").alias("right_id"), "cluster_id"), "cluster_id").where("left_id > right_id").select("left_id", "right_id")
    return pairs_completeness(dedupe_candidates(spark, d), together, unordered=True).select(F.round("pairs_completeness", 9).alias("pairs_completeness"))


def union_of_tables(spark, d):
    s = _t(spark, d, "result_scores").groupBy("left_id", "right_id", "block").agg(F.max("sim").alias("sim"))
    l = _t(spark, d, "result_links").groupBy("left_id", "right_id", "block").agg(F.max("sim").alias("sim"))
    return union_candidates(l, s).select("left_id", "right_id", "block", F.round("sim", 6).alias("sim"))


def unproposed_records(spark, d):
    a = unproposed(_firms(spark, d), "gvkey", _t(spark, d, "result_scores"), "left_id").select(F.lit("left").alias("side"), F.col("gvkey").alias("id"))
    b = unproposed(_assignees(spark, d), "assignee_id", _t(spark, d, "result_scores"), "right_id").select(F.lit("right").alias("side"), F.col("assignee_id").alias("id"))
    return a.unionByName(b)


def pairs_of_linked_firms(spark, d):
    return all_left(_scores(spark, d), _links(spark, d).select(F.col("left_id").alias("gvkey")), "gvkey").select("left_id", "right_id")


# --- judging


def _judged(spark, d, **options):
    c = _scores(spark, d).select("left_id", "right_id", "block", "sim")
    return judge(c, _firms(spark, d), _assignees(spark, d), ColumnJudge(F.col("sim"), "similarity"), on=[NAME, "state"], left_id="gvkey", right_id="assignee_id", entity="firm", **options)


def judge_exact_shortcut(spark, d):
    return _judged(spark, d, budget=None, exact_shortcut=True).select("left_id", "right_id", "p", "source")


def judge_budget(spark, d):
    """How far a budget reaches: distinct questions at a cent each, the likeliest first."""
    return _judged(spark, d, budget=25.0, price=0.01).groupBy("source").agg(F.count(F.lit(1)).alias("pairs"), F.min(F.when(F.col("source") == "jev", F.col("sim"))).alias("least_sim"))


def judge_shared_states(spark, d):
    return _judged(spark, d, budget=None).groupBy("score_origin").agg(F.count(F.lit(1)).alias("pairs"))


def resume_todo(spark, d):
    return todo(_t(spark, d, "result_scores")).groupBy("source").agg(F.count(F.lit(1)).alias("pairs"))


def estimate_tokens(spark, d):
    c = _scores(spark, d).select("left_id", "right_id", "sim")
    ask = question("firm")
    full = states(c, _firms(spark, d), _assignees(spark, d), [NAME, "state"], "gvkey", "assignee_id", ask)
    return pair_tokens(full, ask, sample=200)


# --- resolving and clustering


def margins(spark, d):
    return with_margin(_scores(spark, d)).select("left_id", "right_id", F.round("margin", 9).alias("margin"))


def _resolved(spark, d, how, **options):
    return resolve(_scores(spark, d), how=how, **options).select("left_id", "right_id", "p", F.round("margin", 9).alias("margin"))


def resolve_many_to_many(spark, d):
    return _resolved(spark, d, "many-to-many")


def resolve_many_to_one(spark, d):
    return _resolved(spark, d, "many-to-one")


def resolve_one_to_many(spark, d):
    return _resolved(spark, d, "one-to-many")


def resolve_min_margin(spark, d):
    return _resolved(spark, d, "many-to-one", min_margin=0.1)


def resolve_one_to_one(spark, d):
    return _resolved(spark, d, "one-to-one")


def resolve_greedy(spark, d):
    return greedy_matching(_scores(spark, d).where("p >= 0.5"), Scratch(spark, "greedy"))


def _self_scores(spark, d):
    """Scores among assignees: pairs that share a saved cluster or an exact name, p from how many of name, city and year agree."""
    a = _assignees(spark, d)
    pairs = dedupe_candidates(spark, d).select("left_id", "right_id")
    x = a.select(F.col("assignee_id").alias("left_id"), normalize("assignee").alias("na"), normalize("city").alias("ca"), F.col("year").alias("ya"))
    y = a.select(F.col("assignee_id").alias("right_id"), normalize("assignee").alias("nb"), normalize("city").alias("cb"), F.col("year").alias("yb"))
    same = lambda u, v: F.when((F.col(u) == F.col(v)) & (F.col(u).cast("string") != ""), 1).otherwise(0)
    p = (2 * same("na", "nb") + same("ca", "cb") + same("ya", "yb")) / 4.0
    return pairs.join(x, "left_id").join(y, "right_id").select("left_id", "right_id", p.alias("p"))


def cluster_components(spark, d):
    return cluster(_self_scores(spark, d), ids=_assignees(spark, d), id="assignee_id", threshold=0.5, linkage="components")


def cluster_average(spark, d):
    return cluster(_self_scores(spark, d), ids=_assignees(spark, d), id="assignee_id", threshold=0.5)


def cluster_average_ignore(spark, d):
    return cluster(_self_scores(spark, d), threshold=0.6, unproposed="ignore")


def components_orders(spark, d):
    """Customers and the parts they order: components of the bipartite graph of part and supplier."""
    l = _t(spark, d, "lineitem")
    return connected_components(l.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")).distinct(), "a", "b").groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


def dedupe_links(spark, d):
    return cluster_links(_self_scores(spark, d), _clusters(spark, d)).select("left_id", "right_id", "p", "cluster_id")


def dedupe_split_pairs(spark, d):
    return split_pairs(_self_scores(spark, d), _clusters(spark, d), 0.5).select("left_id", "right_id", "left_cluster", "right_cluster")


def dedupe_labeled(spark, d):
    return labeled(_assignees(spark, d), "assignee_id", _clusters(spark, d)).select("assignee_id", "cluster_id", "cluster_size")


# --- auditing and measuring


def audit_sample(spark, d):
    s = A.audit_sample(_scores(spark, d), n=200, seed=7, links=_links(spark, d).join(_scores(spark, d).where("p is not null").select("left_id", "right_id"), ["left_id", "right_id"]))
    return s.select("left_id", "right_id", "p", "selected", "bin", F.round("weight", 9).alias("weight"))


def audit_fields(spark, d):
    return A.with_fields(_links(spark, d), _firms(spark, d), _assignees(spark, d), [NAME, "state", ("year", None)], "gvkey", "assignee_id")[0]


def _labels(spark, d):
    """Every judged pair labelled by the truth, one label in about eight blank, with bins and weights."""
    t = _truth(spark, d).distinct().withColumn("_t", F.lit(1))
    s = _scores(spark, d).where("p is not null").join(t, ["left_id", "right_id"], "left")
    blank = F.substring(F.md5(F.concat_ws("|", "left_id", "right_id")), 1, 1).isin("0", "f")
    selected = _links(spark, d).withColumn("_s", F.lit(1))
    s = s.join(selected, ["left_id", "right_id"], "left")
    return s.select("left_id", "right_id", "p", A.bin_of(F.col("p")).alias("bin"), (1.0 + F.col("sim")).alias("weight"), F.when(blank, "").otherwise(F.when(F.col("_t").isNotNull(), "yes").otherwise("no")).alias("is_match"), F.when(F.col("_s").isNotNull(), "yes").otherwise("no").alias("selected"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


def evaluate_threshold(spark, d):
    return _rounded(A.metrics(_labels(spark, d), 0.5), "precision", "recall", "f1", "brier")


def evaluate_selected(spark, d):
    return _rounded(A.metrics(_labels(spark, d), 0.5, "selected"), "precision", "recall", "f1", "brier")


def calibration_table(spark, d):
    return _rounded(A.calibration(_labels(spark, d)), "mean_p", "match_rate")


def evaluate_bootstrap(spark, d):
    e = A.evaluate(_labels(spark, d), n_boot=200)
    return spark.createDataFrame([(n, *map(float, v)) for n, v in (("precision", e.precision), ("recall", e.recall), ("f1", e.f1))], "metric string, estimate double, low double, high double")


def score_against_truth(spark, d):
    return _rounded(A.score_against_truth(_links(spark, d), _truth(spark, d), _scores(spark, d)), "precision", "recall", "f1", "pairs_completeness")


def stage_metrics(spark, d):
    return _rounded(B.stage_metrics(_scores(spark, d), _links(spark, d), _truth(spark, d)), "blocking_recall", "conditional_recall", "final_recall", "precision")


def recall_by_source(spark, d):
    return B.recall_by_source(_scores(spark, d), _truth(spark, d))


def diagnose_errors(spark, d):
    return B.diagnose(_scores(spark, d), _links(spark, d), _truth(spark, d))


def baseline_exact(spark, d):
    return B.exact_matches(_firms(spark, d), _assignees(spark, d), on=[NAME], left_id="gvkey", right_id="assignee_id")


def baseline_jaro_winkler(spark, d):
    return _rounded(B.jaro_winkler_matches(_firms(spark, d), _assignees(spark, d), on=[NAME], left_id="gvkey", right_id="assignee_id"), "sim")


def baseline_tfidf(spark, d):
    return _rounded(B.tfidf_matches(_firms(spark, d), _assignees(spark, d), on=[NAME], left_id="gvkey", right_id="assignee_id"), "sim")


def tune_threshold(spark, d):
    return _rounded(B.tune_threshold(_scores(spark, d), _truth(spark, d)), "precision", "recall", "f1")


def threshold_sweep(spark, d):
    return _rounded(B.threshold_sweep(_scores(spark, d), _truth(spark, d)), "precision", "recall", "f1")


def choose_threshold(spark, d):
    return _rounded(B.choose_threshold(_scores(spark, d), _truth(spark, d)), "precision", "recall", "f1")


def string_scores(spark, d):
    s = B.string_scores(_scores(spark, d).drop("p"), _firms(spark, d), _assignees(spark, d), on=[NAME], left_id="gvkey", right_id="assignee_id", method="exact")
    return s.select("left_id", "right_id", "p")


def _agreed(spark, d):
    return B.agreement(_scores(spark, d).select("left_id", "right_id"), _firms(spark, d), _assignees(spark, d), on=[NAME, "state", "city"], left_id="gvkey", right_id="assignee_id")


def ecm_patterns(spark, d):
    return B.patterns(_agreed(spark, d), 3)


def ecm_scores(spark, d):
    return B.ecm_scores(_agreed(spark, d), 3).select("left_id", "right_id", F.round("p", 6).alias("p"))


def entity_split(spark, d):
    return B.entity_split(_firms(spark, d), _assignees(spark, d), _truth(spark, d), on=[NAME], left_id="gvkey", right_id="assignee_id")


def unmatched_right(spark, d):
    return B.make_unmatched(_assignees(spark, d), _truth(spark, d), "assignee_id", 0.25).select("assignee_id")


def canonical_names(spark, d):
    return B.canonical_names(_assignees(spark, d).join(_clusters(spark, d).withColumnRenamed("id", "assignee_id"), "assignee_id"), "cluster_id", "assignee")


def judge_agreement(spark, d):
    s = _t(spark, d, "result_scores")
    by = lambda m: s.where(F.col("model") == m).groupBy("left_id", "right_id").agg(F.max(probability(F.col("p"))).alias("p"))
    return _rounded(B.judge_agreement(by("small-a"), by("small-b")), "agreement", "kappa", "spearman")


def _pair_texts(spark, d):
    l = _labels(spark, d).where("is_match <> ''").withColumn("gold", F.col("is_match") == "yes")
    return l.join(_firms(spark, d).select(F.col("gvkey").alias("left_id"), "conm"), "left_id").join(_assignees(spark, d).select(F.col("assignee_id").alias("right_id"), "assignee"), "right_id")


def mixed_labels(spark, d):
    return B.mixed_labels(_pair_texts(spark, d), normalize("conm"), normalize("assignee"), "gold")


def text_ceiling(spark, d):
    return B.text_ceiling(_pair_texts(spark, d), normalize("conm"), normalize("assignee"), "gold")


def hardest_negatives(spark, d):
    return B.hardest_negatives(_scores(spark, d), _truth(spark, d)).select("left_id", "right_id", "rank")


def equal_links(spark, d):
    return B.equal_links(_scores(spark, d), 300).select("left_id", "right_id", "p")


def pair_classification(spark, d):
    return _rounded(B.pair_classification(_pair_texts(spark, d).select("left_id", "right_id", "gold"), _scores(spark, d), "gold"), "precision", "recall", "f1")


# --- reports and review


def merged_links(spark, d):
    l = resolve(_scores(spark, d), how="many-to-one")
    return merged(l, _firms(spark, d).drop("loaded_at"), _assignees(spark, d).drop("loaded_at"), "gvkey", "assignee_id").drop("margin")


def report_counts(spark, d):
    s = _t(spark, d, "result_scores")
    return s.groupBy("source", "block").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("left_id").alias("lefts"), F.round(F.median(probability(F.col("p"))), 6).alias("median_p"))


def meter_totals(spark, d):
    return _t(spark, d, "result_scores").groupBy("model", "provider", "score_origin").agg(F.count(F.lit(1)).alias("answers"))


def _decisions(spark, d):
    """The best scored pair of every second firm by hash is accepted, and the weakest pair of each other firm rejected."""
    s = _scores(spark, d).where("p is not null")
    h = F.substring(F.md5("left_id"), 1, 1) < "8"
    up = s.groupBy("left_id").agg(F.max(F.struct("p", "right_id")).alias("m")).where(h).select("left_id", F.col("m.right_id").alias("right_id"), F.lit("accept").alias("decision"))
    down = s.groupBy("left_id").agg(F.min(F.struct("p", "right_id")).alias("m")).where(~h).select("left_id", F.col("m.right_id").alias("right_id"), F.lit("reject").alias("decision"))
    return up.unionByName(down)


def review_apply(spark, d):
    return apply_decisions(_scores(spark, d), _decisions(spark, d), how="many-to-one", threshold=0.5, original=_links(spark, d)).select("left_id", "right_id", "p", "selection_basis", "review_decision", "original_selected")


def review_latest(spark, d):
    """Every decision amended once: the amendment holds."""
    one = _decisions(spark, d).select(F.md5(F.concat_ws("|", "left_id", "right_id")).alias("event_id"), F.lit(None).cast("string").alias("previous_event"), "left_id", "right_id", "decision")
    two = one.select(F.concat(F.lit("b"), F.col("event_id")).alias("event_id"), F.col("event_id").alias("previous_event"), "left_id", "right_id", F.lit("unsure").alias("decision")).where("decision is not null and substring(previous_event, 1, 1) < '8'")
    return latest(one.unionByName(two))


def review_selected(spark, d):
    return selected_scores(_scores(spark, d), _links(spark, d)).groupBy("selected").agg(F.count(F.lit(1)).alias("pairs"), F.max("p").alias("best_p"))


def aligned_ids(spark, d):
    """Links read as text, brought back to the firms' own IDs."""
    return align_ids(_links(spark, d), "left_id", _firms(spark, d), "gvkey")


def review_queue_left(spark, d):
    return _rounded(review_queue(_firms(spark, d), "gvkey", _scores(spark, d), _links(spark, d), "left_id"), "gap")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Names to links: candidates from two passes with their similarity, judged by it, best right of each left with its margin."""
    c = _two_passes(spark, d).frame
    scores = judge(c, _firms(spark, d), _assignees(spark, d), ColumnJudge(F.col("sim"), "similarity"), on=[NAME, "city"], left_id="gvkey", right_id="assignee_id", entity="firm", budget=None)
    links = resolve(scores, how="many-to-one", threshold=0.5)
    return links.select("left_id", "right_id", "block", F.round("sim", 6).alias("sim"), F.round("p", 6).alias("p"), F.round("margin", 6).alias("margin"))


def link_firms(spark, d):
    return flagship(spark, d)


_NOT_QUERIES = {"audit", "flagship", "queries", "oracle_sql"}
_HERE = [k for k, v in list(globals().items()) if callable(v) and not k.startswith("_") and getattr(v, "__module__", "") == __name__ and k not in _NOT_QUERIES]


def queries() -> dict:
    return {k: globals()[k] for k in _HERE}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _HERE}
