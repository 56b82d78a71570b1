"""Baseline matchers and the measures of benchmark runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.fields import parse_on
from kindred.functions.text import jaro_winkler, normalize, record_text
from kindred.operators.audit import BINS, bin_of, score_against_truth
from kindred.operators.components import connected_components
from kindred.operators.grid import WinklerIndex, over_cells
from kindred.operators.resolve import probability, resolve
from kindred.operators.vectors import nearest_texts, vectors
from kindred.ranking import place, running_sum
from kindred.scratch import Scratch


def _texts(left: DataFrame, right: DataFrame, on, left_id: str, right_id: str) -> tuple[DataFrame, DataFrame]:
    f = parse_on(on)
    return left.select(F.col(left_id).alias("left_id"), record_text([x.left for x in f]).alias("lt")), right.select(F.col(right_id).alias("right_id"), record_text([x.right for x in f]).alias("rt"))


def exact_matches(left: DataFrame, right: DataFrame, *, on, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, sim): records with equal normalized text, sim 1; plain text equality, without folding of numbers."""
    a, b = _texts(left, right, on, left_id, right_id)
    return a.where("lt <> ''").join(b, F.col("lt") == F.col("rt")).select("left_id", "right_id", F.lit(1.0).alias("sim"))


def _best(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("left_id").orderBy(F.desc("sim"), "right_id")
    return pairs.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("left_id", "right_id", "sim")


def jaro_winkler_matches(left: DataFrame, right: DataFrame, *, on, left_id: str, right_id: str) -> DataFrame:
    """Each left record's best right by Jaro-Winkler among those with the same first character; ties go to the smaller ID. Distinct texts
    are compared once, likeliest first and only as far as the best can still be beaten (see WinklerIndex)."""
    a, b = _texts(left, right, on, left_id, right_id)
    a, b = a.where("lt <> ''"), b.where("rt <> ''")
    kind = b.schema["right_id"].dataType
    items = b.groupBy(F.col("rt").alias("text")).agg(F.min("right_id").alias("first")).withColumn("c", F.substring("text", 1, 1)).select("c", "first", "text")
    asked = a.select(F.col("lt").alias("text")).distinct().select(F.substring("text", 1, 1).alias("c"), F.lit(None).cast(kind).alias("first"), "text")
    schema = T.StructType([T.StructField("lt", T.StringType()), T.StructField("right_id", kind), T.StructField("sim", T.DoubleType())])
    sims = over_cells(asked, items, ["c"], ["first", "text"], lambda held: WinklerIndex(held, schema.names), schema, 20_000)
    return _best(a.join(sims, "lt"))


def tfidf_matches(left: DataFrame, right: DataFrame, *, on, left_id: str, right_id: str, grams: tuple[int, int] = (2, 4)) -> DataFrame:
    """Each left record's best right by cosine of TF-IDF n-grams over the whole text."""
    a, b = _texts(left, right, on, left_id, right_id)
    x, y = a.withColumnsRenamed({"left_id": "id", "lt": "text"}), b.withColumnsRenamed({"right_id": "id", "rt": "text"})
    packed = Scratch(left.sparkSession, "tfidf").cut(vectors(x, y, *grams, whole_text=True))
    few = b.groupBy("rt").agg(F.min("right_id").alias("right_id"))
    sims = nearest_texts(x, y, packed, 1, 0.0).join(few, "rt").select("lt", "right_id", "sim")
    return _best(a.join(sims, "lt"))


def string_scores(candidates: DataFrame, left: DataFrame, right: DataFrame, *, on, left_id: str, right_id: str, method: str) -> DataFrame:
    """Candidates with p set to a string similarity: exact, tfidf (the pair's sim) or jaro_winkler."""
    if method == "tfidf":
        return candidates.withColumn("p", F.col("sim"))
    a, b = _texts(left, right, on, left_id, right_id)
    met = candidates.join(a, "left_id").join(b, "right_id")
    p = F.when((F.col("lt") == F.col("rt")) & (F.col("lt") != ""), 1.0).otherwise(0.0) if method == "exact" else F.coalesce(jaro_winkler(F.col("lt"), F.col("rt")), F.lit(0.0))
    return met.withColumn("p", p).drop("lt", "rt")


def tune_threshold(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the threshold on sim of best F1 over every distinct score, ties to fewer links; tied scores are never split.

    Counts are taken by distinct score first, so the running sums see one row a score."""
    t = truth.select("left_id", "right_id").distinct().withColumn("_t", F.lit(1))
    by = scored.select("left_id", "right_id", "sim").distinct().join(t, ["left_id", "right_id"], "left").groupBy("sim").agg(F.count(F.lit(1)).alias("n"), F.count("_t").alias("good"))
    scratch = Scratch(scored.sparkSession, "tune")
    by = running_sum(by.withColumn("_d", -F.col("sim")), ["_d"], F.col("n"), "links", scratch)
    run = running_sum(by, ["_d"], F.col("good"), "tp", scratch).select("sim", "links", "tp").crossJoin(t.agg(F.count(F.lit(1)).alias("truth")))  # one row
    f1 = 2 * F.col("tp") / (F.col("links") + F.col("truth"))
    best = run.withColumn("f1", f1).orderBy(F.desc("f1"), "links").limit(1)
    return best.select(F.col("sim").alias("threshold"), "links", "tp", (F.col("tp") / F.col("links")).alias("precision"), F.when(F.col("truth") > 0, F.col("tp") / F.col("truth")).alias("recall"), "f1")


# --- Fellegi-Sunter with expectation maximisation over agreement patterns


def agreement(pairs: DataFrame, left: DataFrame, right: DataFrame, *, on, left_id: str, right_id: str, least: float = 0.9) -> DataFrame:
    """Pairs with one 0/1 column g0, g1, ... a field: Jaro-Winkler of the normalized values at least 0.9, 0 for blanks."""
    f = parse_on(on)
    a = left.select(F.col(left_id).alias("left_id"), *[normalize(x.left).alias(f"_a{i}") for i, x in enumerate(f)])
    b = right.select(F.col(right_id).alias("right_id"), *[normalize(x.right).alias(f"_b{i}") for i, x in enumerate(f)])
    met = pairs.join(a, "left_id").join(b, "right_id")
    one = lambda i: F.when((F.col(f"_a{i}") == "") | (F.col(f"_b{i}") == ""), 0).otherwise((jaro_winkler(F.col(f"_a{i}"), F.col(f"_b{i}")) >= least).cast("int"))
    return met.withColumns({f"g{i}": one(i) for i in range(len(f))}).drop(*[f"_{s}{i}" for s in "ab" for i in range(len(f))])


def patterns(agreed: DataFrame, fields: int) -> DataFrame:
    """How many pairs show each agreement pattern: at most 2**fields rows."""
    return agreed.groupBy(*[f"g{i}" for i in range(fields)]).agg(F.count(F.lit(1)).alias("n"))


def ecm(rows: list[tuple], rounds: int = 100, tol: float = 1e-5) -> tuple[float, list[float], list[float]]:
    """(share of matches, m, u) fitted to pattern rows (g0, ..., n): the chance of agreement among matches and among others."""
    k = len(rows[0]) - 1
    total = sum(r[-1] for r in rows)
    if sum(len({r[i] for r in rows}) > 1 for i in range(k)) < 2:
        raise ValueError("at least two fields must vary")
    share, m, u = 0.1, [0.9] * k, [max(0.01, min(0.99, sum(r[-1] for r in rows if r[i]) / total)) for i in range(k)]
    clip = lambda x: min(max(x, 1e-6), 1 - 1e-6)
    for _ in range(rounds):
        post = []
        for r in rows:
            a, b = share, 1 - share
            for i in range(k):
                a *= m[i] if r[i] else 1 - m[i]
                b *= u[i] if r[i] else 1 - u[i]
            post.append(a / (a + b))
        match = sum(g * r[-1] for g, r in zip(post, rows))
        new = [clip(sum(g * r[-1] for g, r in zip(post, rows) if r[i]) / max(match, 1e-12)) for i in range(k)]
        other = [clip(sum((1 - g) * r[-1] for g, r in zip(post, rows) if r[i]) / max(total - match, 1e-12)) for i in range(k)]
        moved = max(abs(x - y) for x, y in zip([*new, *other, match / total], [*m, *u, share]))
        share, m, u = clip(match / total), new, other
        if moved < tol:
            break
    return share, m, u


def ecm_scores(agreed: DataFrame, fields: int, rounds: int = 100) -> DataFrame:
    """Pairs with p, the posterior chance of a match. The fit sees only the pattern counts."""
    share, m, u = ecm([tuple(r) for r in patterns(agreed, fields).orderBy(*[f"g{i}" for i in range(fields)]).collect()], rounds)
    log = F.lit(math.log(share / (1 - share)))
    for i in range(fields):
        log = log + F.when(F.col(f"g{i}") == 1, math.log(m[i] / u[i])).otherwise(math.log((1 - m[i]) / (1 - u[i])))
    return agreed.withColumn("p", 1 / (1 + F.exp(-log)))


# --- Splits and measures


def entity_split(left: DataFrame, right: DataFrame, truth: DataFrame, *, on, left_id: str, right_id: str, dev_fraction: float = 0.3, seed: int = 1729, scratch: Scratch | None = None) -> DataFrame:
    """(side, id, part): records in dev and test parts without a shared entity. Records are one entity through truth pairs and through equal
    normalized text; entities go to dev in the order of their hash until floor(fraction * entities)."""
    scratch = scratch or Scratch(left.sparkSession, "split")
    a, b = _texts(left, right, on, left_id, right_id)
    node = lambda side, c: F.concat(F.lit(side), F.col(c).cast("string"))
    recs = a.select(F.lit("left").alias("side"), F.col("left_id").cast("string").alias("id"), node("l", "left_id").alias("node"), F.col("lt").alias("text")).unionByName(
        b.select(F.lit("right").alias("side"), F.col("right_id").cast("string").alias("id"), node("r", "right_id").alias("node"), F.col("rt").alias("text"))
    )
    # a text is a node of its own, so a text of many records costs one edge each
    edges = truth.select(node("l", "left_id").alias("a"), node("r", "right_id").alias("b")).unionByName(recs.where("text <> ''").select(F.col("node").alias("a"), F.concat(F.lit("t"), F.sha2("text", 256)).alias("b")))
    comp = connected_components(edges, "a", "b", recs, "node", scratch)
    groups = recs.join(comp, "node").groupBy("component").agg(F.min("node").alias("least"))
    ranked = place(groups.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(str(seed)), "least"), 256)), ["_h", "least"], "_k", scratch).crossJoin(groups.agg(F.count(F.lit(1)).alias("_n")))  # one row
    part = F.when(F.col("_k") <= F.floor(F.lit(dev_fraction) * F.col("_n")), "dev").otherwise("test")
    return recs.join(comp, "node").join(ranked.select("component", part.alias("part")), "component").select("side", "id", "part")


def make_unmatched(right: DataFrame, truth: DataFrame, right_id: str, share: float, seed: int = 0) -> DataFrame:
    """The right table without the counterparts of a hash-ordered share of the true pairs."""
    t = truth.select("left_id", "right_id").distinct()
    scratch = Scratch(right.sparkSession, "unmatched")
    k = place(t.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "left_id", "right_id"))), ["_h", "left_id", "right_id"], "_k", scratch).crossJoin(t.agg(F.floor(F.count(F.lit(1)) * share).alias("_m")))  # one row
    return right.join(k.where("_k <= _m").select(F.col("right_id").alias(right_id)).distinct(), right_id, "left_anti")


def stage_metrics(candidates: DataFrame, links: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: blocking recall, the judge's recall of proposed truth, and the final recall and precision."""
    pair = ["left_id", "right_id"]
    t = truth.select(*pair).distinct().withColumn("_t", F.lit(1))
    c, l = candidates.select(*pair).distinct().withColumn("_c", F.lit(1)), links.select(*pair).distinct().withColumn("_l", F.lit(1))
    got = t.join(c, pair, "full").join(l, pair, "full")
    n = lambda *cs: F.count(F.when(sum([F.col(x).isNotNull().cast("int") for x in cs]) == len(cs), 1))
    g = got.agg(n("_t").alias("truth"), n("_c").alias("candidates"), n("_l").alias("links"), n("_t", "_c").alias("proposed"), n("_t", "_l").alias("found"))
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return g.select("truth", "candidates", "links", div("proposed", "truth").alias("blocking_recall"), div("found", "proposed").alias("conditional_recall"), div("found", "truth").alias("final_recall"), div("found", "links").alias("precision"))


def recall_by_source(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(block, pairs, true_pairs) of each way a pair was proposed."""
    t = truth.select("left_id", "right_id").distinct().withColumn("_t", F.lit(1))
    return candidates.join(t, ["left_id", "right_id"], "left").groupBy("block").agg(F.count(F.lit(1)).alias("pairs"), F.count("_t").alias("true_pairs"))


def threshold_sweep(scores: DataFrame, truth: DataFrame, how: str = "many-to-one", grid: tuple[float, ...] = tuple(round(0.05 * i, 2) for i in range(21))) -> DataFrame:
    """(threshold, links, tp, precision, recall, f1) after the final assignment at each threshold of a fixed grid.

    The best pair of a record does not depend on the threshold, so the assignment runs once for the one-sided rules."""
    t = truth.select("left_id", "right_id").distinct().withColumn("_t", F.lit(1))
    if how == "one-to-one":
        every = None
        for x in grid:
            one = resolve(scores, how=how, threshold=x).select("left_id", "right_id", "p", F.lit(x).alias("threshold"))
            every = one if every is None else every.unionByName(one)
    else:
        every = resolve(scores, how=how, threshold=0.0).select("left_id", "right_id", "p", F.explode(F.array(*[F.lit(x) for x in grid])).alias("threshold")).where("p >= threshold")
    got = every.join(t, ["left_id", "right_id"], "left").groupBy("threshold").agg(F.count(F.lit(1)).alias("links"), F.count("_t").alias("tp"))
    spark = scores.sparkSession
    g = spark.createDataFrame([(float(x),) for x in grid], "threshold double")
    full = g.join(got, "threshold", "left").na.fill(0, ["links", "tp"]).crossJoin(t.agg(F.count(F.lit(1)).alias("n")))  # one row
    div = lambda a, b: F.when(b > 0, a / b)
    return full.select("threshold", "links", "tp", div(F.col("tp"), F.col("links")).alias("precision"), div(F.col("tp"), F.col("n")).alias("recall"), div(2 * F.col("tp"), F.col("links") + F.col("n")).alias("f1"))


def choose_threshold(scores: DataFrame, truth: DataFrame, how: str = "many-to-one", grid: tuple[float, ...] = tuple(round(0.05 * i, 2) for i in range(21))) -> DataFrame:
    """The row of the sweep with the best F1 after assignment; equal F1 goes to fewer links, then to the lower threshold."""
    return threshold_sweep(scores, truth, how, grid).orderBy(F.desc(F.coalesce("f1", F.lit(-1.0))), "links", "threshold").limit(1)


def canonical_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, canonical, aliases): the most frequent spelling of each key, ties to the first in order, and all spellings joined."""
    n = df.where(F.col(key).isNotNull() & F.col(name).isNotNull()).groupBy(key, F.col(name).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_s").alias("s")))["s"].alias("canonical"), F.array_join(F.array_sort(F.collect_set("_s")), " | ").alias("aliases"))


def judge_agreement(a: DataFrame, b: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: how two judges agree on the pairs both scored: confusion counts, agreement, Cohen's kappa, and Spearman's rho.

    Ranks are averages of ties, made from counts by distinct p."""
    x = a.select("left_id", "right_id", probability(F.col("p")).alias("pa")).where("pa is not null")
    y = b.select("left_id", "right_id", probability(F.col("p")).alias("pb")).where("pb is not null")
    m = x.join(y, ["left_id", "right_id"])
    scratch = Scratch(a.sparkSession, "agreement")

    def ranked(c: str) -> DataFrame:
        n = m.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        upto = running_sum(n, [c], F.col("n"), "_upto", scratch)
        return upto.select(c, (F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    m = m.join(ranked("pa"), "pa").join(ranked("pb"), "pb").withColumns({"ya": (F.col("pa") >= threshold).cast("int"), "yb": (F.col("pb") >= threshold).cast("int")})
    n = lambda i, j: F.count(F.when((F.col("ya") == i) & (F.col("yb") == j), 1))
    g = m.agg(n(1, 1).alias("both_yes"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("both_no"), F.corr("rpa", "rpb").alias("spearman"))
    total = F.col("both_yes") + F.col("only_a") + F.col("only_b") + F.col("both_no")
    agree = F.try_divide(F.col("both_yes") + F.col("both_no"), total)
    by_chance = (F.col("both_yes") + F.col("only_a")) * (F.col("both_yes") + F.col("only_b")) + (F.col("both_no") + F.col("only_a")) * (F.col("both_no") + F.col("only_b"))
    chance = F.try_divide(by_chance, total * total)
    return g.select("both_yes", "only_a", "only_b", "both_no", agree.alias("agreement"), F.when(chance < 1, (agree - chance) / (1 - chance)).alias("kappa"), "spearman")


def abstention(links: DataFrame, unmatched: DataFrame) -> DataFrame:
    """(side, records, false_linked, correct_abstention_rate): of the records known to have no counterpart, (side, id), how many were linked
    all the same. A side without such records has no row."""
    used = links.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").cast("string").alias("id")) for s in ("left", "right")])).alias("x")).select("x.*").distinct().withColumn("_l", F.lit(1))
    known = unmatched.select("side", F.col("id").cast("string").alias("id")).distinct().join(used, ["side", "id"], "left")
    by = known.groupBy("side").agg(F.count(F.lit(1)).alias("records"), F.count("_l").alias("false_linked"))
    return by.withColumn("correct_abstention_rate", 1 - F.col("false_linked") / F.col("records"))


def pair_metrics(links: DataFrame, truth: DataFrame, complete: bool = True) -> DataFrame:
    """One row: found pairs against true ones. An incomplete truth lists some true pairs only, so nothing can be called wrong: fp,
    precision and f1 are null then."""
    got = score_against_truth(links, truth, empty=0.0)
    return got if complete else got.select("tp", F.lit(None).cast("long").alias("fp"), "fn", *[(F.col(c) if c == "recall" else F.lit(None).cast("double")).alias(c) for c in ("precision", "recall", "f1")])


def plain_calibration(labels: DataFrame, gold: str, edges: tuple[float, ...] = BINS) -> DataFrame:
    """(bin, n, mean_p, match_rate): how often pairs of each bin of p are true, every pair counting once."""
    rows = labels.where(probability(F.col("p")).isNotNull()).groupBy(bin_of(F.col("p"), edges).alias("bin"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col(gold).cast("int")).alias("match_rate"))


def family_choice(runs: DataFrame, last: tuple[str, ...] = ()) -> DataFrame:
    """(family, variant, dev_f1, test_low, test_high, tied) of each family's best variant on dev. runs has (family, variant, dev_f1, test_f1);
    scores within 1e-9 are tied, ties go to names without a part of ``last``, then to the first name; the range is of all tied ones."""
    w = Window.partitionBy("family")
    late = F.greatest(F.lit(0), *[F.col("variant").contains(x).cast("int") for x in last]) if last else F.lit(0)
    tied = runs.withColumn("_m", F.max("dev_f1").over(w)).where(F.abs(F.col("dev_f1") - F.col("_m")) < 1e-9)
    first = F.min(F.struct(late.alias("late"), "variant", "dev_f1")).alias("x")
    return tied.groupBy("family").agg(first, F.min("test_f1").alias("test_low"), F.max("test_f1").alias("test_high"), F.count(F.lit(1)).alias("tied")).select("family", "x.variant", "x.dev_f1", "test_low", "test_high", "tied")


def diagnose(candidates: DataFrame, links: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, left_id, right_id) of every error: retrieval_miss, false_negative, false_positive."""
    pair = ["left_id", "right_id"]
    t, c, l = (d.select(*pair).distinct().withColumn(n, F.lit(1)) for d, n in ((truth, "_t"), (candidates, "_c"), (links, "_l")))
    m = t.join(c, pair, "full").join(l, pair, "full")
    kind = F.when(F.col("_t").isNotNull() & F.col("_c").isNull(), "retrieval_miss").when(F.col("_t").isNotNull() & F.col("_l").isNull(), "false_negative").when(F.col("_t").isNull() & F.col("_l").isNotNull(), "false_positive")
    return m.withColumn("kind", kind).where("kind is not null").select("kind", *pair)


def mixed_labels(labels: DataFrame, left_text: Column, right_text: Column, gold: str) -> DataFrame:
    """(lt, rt, n, yes): pairs of equal texts that truth labels both ways, which no judge of texts can get right."""
    g = labels.groupBy(left_text.alias("lt"), right_text.alias("rt")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(gold).cast("int")).alias("yes"))
    return g.where("yes > 0 and yes < n")


def text_ceiling(labels: DataFrame, left_text: Column, right_text: Column, gold: str) -> DataFrame:
    """One row: the most pairs that any rule on the texts alone could get right."""
    g = labels.groupBy(left_text.alias("lt"), right_text.alias("rt")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(gold).cast("int")).alias("yes"))
    return g.agg(F.sum(F.greatest(F.col("yes"), F.col("n") - F.col("yes"))).alias("ceiling"), F.sum("n").alias("pairs"))


def hardest_negatives(scores: DataFrame, truth: DataFrame, n: int = 3) -> DataFrame:
    """The n likeliest wrong partners of each left record that has a true one: training pairs for another matcher."""
    t = truth.select("left_id", "right_id").distinct()
    w = Window.partitionBy("left_id").orderBy(F.desc("sim"), "right_id")
    wrong = scores.join(t, ["left_id", "right_id"], "left_anti").join(t.select("left_id").distinct(), "left_id", "left_semi")
    return wrong.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def equal_links(scores: DataFrame, n: int, score: str = "p") -> DataFrame:
    """The n best of the records' best pairs, for comparing methods at one number of links."""
    w = Window.partitionBy("left_id").orderBy(F.desc(score), "right_id")
    best = scores.where(probability(F.col(score)).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return best.orderBy(F.desc(score), "left_id", "right_id").limit(n)


def pair_classification(labels: DataFrame, scores: DataFrame, gold: str, threshold: float = 0.5) -> DataFrame:
    """One row: precision, recall and F1 of scored pairs against a label on every pair; a pair without p counts as no match."""
    m = labels.join(scores.select("left_id", "right_id", probability(F.col("p")).alias("p")), ["left_id", "right_id"], "left").withColumn("z", F.coalesce(F.col("p") >= threshold, F.lit(False)))
    y = F.col(gold).cast("boolean")
    g = m.agg(F.count(F.when(y & F.col("z"), 1)).alias("tp"), F.count(F.when(~y & F.col("z"), 1)).alias("fp"), F.count(F.when(y & ~F.col("z"), 1)).alias("fn"), F.count(F.when(F.col("p").isNull(), 1)).alias("unjudged"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select("tp", "fp", "fn", "unjudged", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def merge_scores(a: DataFrame, b: DataFrame, suffix: str) -> DataFrame:
    """Two score tables side by side by pair; a repeated pair in the second is an error."""
    pair = ["left_id", "right_id"]
    if b.groupBy(*pair).count().where("count > 1").limit(1).count():
        raise ValueError("the second table repeats a pair")
    return a.join(b.withColumnsRenamed({c: c + suffix for c in b.columns if c in a.columns and c not in pair}), pair, "left")
