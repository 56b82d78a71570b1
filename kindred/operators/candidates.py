"""Candidate pairs: the union of passes with their provenance, similarity, limits and diagnostics."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.fields import check_columns, check_ids, parse_on, side_fields
from kindred.functions.text import record_text
from kindred.operators.passes import Exact, NGrams, Pass, Within, default_passes, ngrams
from kindred.operators.vectors import packed_cosines, vectors
from kindred.scratch import Scratch
from kindred.skew import lookup_counted

SIM_GRAMS = (2, 4)
MAX_PAIRS = 5_000_000


@dataclass
class Candidates:
    """Pairs (left_id, right_id, block, sim) and the plan pieces that explain them."""

    frame: DataFrame
    masks: DataFrame
    passes: list[Pass]
    proposals: list[DataFrame]
    max_pairs: int | None
    left: DataFrame
    right: DataFrame
    unordered: bool = False

    def diagnostics(self) -> DataFrame:
        """One row a pass: proposed, unique, added, overlapping, union and exclusive pairs; one aggregation over the union."""
        spark = self.frame.sparkSession
        proposed = None
        for i, p in enumerate(self.proposals):
            one = p.agg(F.count(F.lit(1)).alias("proposed_pairs")).select(F.lit(i).alias("pass"), "proposed_pairs")
            proposed = one if proposed is None else proposed.unionByName(one)
        cols = []
        for i in range(len(self.passes)):
            mine = F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
            earlier = F.col("mask").bitwiseAND(F.lit((1 << i) - 1)) != 0
            upto = F.col("mask").bitwiseAND(F.lit((1 << (i + 1)) - 1)) != 0
            n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
            cols.append(F.struct(F.lit(i).alias("pass"), F.lit(self.passes[i].name).alias("name"), n(mine).alias("unique_pairs"), n(mine & ~earlier).alias("added_pairs"), n(mine & earlier).alias("overlapping_pairs"), n(upto).alias("union_pairs"), n(F.col("mask") == (1 << i)).alias("exclusive_pairs")))
        counts = self.masks.agg(F.array(*cols).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
        del spark
        return counts.join(proposed, "pass").select("pass", "name", "proposed_pairs", "unique_pairs", "added_pairs", "overlapping_pairs", "union_pairs", "exclusive_pairs")

    def report(self) -> dict:
        """The diagnostics as plain data, with pass configurations and dropped values; warns of unreadable and unshared keys."""
        rows = {r["pass"]: r.asDict() for r in self.diagnostics().collect()}
        out = []
        for i, p in enumerate(self.passes):
            entry = rows[i] | {"config": p.to_config()}
            lost = p.dropped(self.left, self.right)
            if lost:
                entry["dropped_values"] = lost
                bad = [f"{lost[s]['unparseable']:,} {s} values in {lost[s]['column']!r}" for s in ("left", "right") if lost[s]["unparseable"]]
                if bad:
                    warnings.warn(f"pass {p.name!r} could not read {' and '.join(bad)} as {lost['kind']}; these records take no part in it", stacklevel=2)
            if not entry["proposed_pairs"] and isinstance(p, (Exact, Within)):
                warnings.warn(f"pass {p.name!r} found nothing: no complete key occurs on both sides ({_examples(p, self.left, self.right)})", stacklevel=2)
            out.append(entry)
        return {"schema_version": 1, "max_pairs": self.max_pairs, "pair_count": out[-1]["union_pairs"] if out else 0, "passes": out, "unordered": self.unordered}


def pair_similarity(pairs: DataFrame, left: DataFrame, right: DataFrame, left_columns: list[str], right_columns: list[str]) -> DataFrame:
    """Adds sim to (l, r): the cosine of both whole records, fitted on both whole tables, whatever pass proposed the pair."""
    a = left.select(F.col("_id").alias("id"), record_text(left_columns).alias("text"))
    b = right.select(F.col("_id").alias("id"), record_text(right_columns).alias("text"))
    packed = vectors(a, b, *SIM_GRAMS)
    side = lambda flag, x: packed.where(flag).select(F.col("text").alias(f"{x}t"), F.col("h").alias(f"h{'ab'[x == 'r']}"), F.col("w").alias(f"w{'ab'[x == 'r']}"))
    pairs = Scratch(left.sparkSession, "pairs").kept(pairs)  # read by two lookups, each of which stands in the plan twice
    total = pairs.count()
    texts = lookup_counted(pairs, a.withColumnsRenamed({"id": "l", "text": "lt"}), "l", "r", total=total)
    texts = lookup_counted(texts, b.withColumnsRenamed({"id": "r", "text": "rt"}), "r", "l", counted=pairs, total=total)
    need = texts.select("lt", "rt").distinct().join(side("_l", "l"), "lt").join(side("_r", "r"), "rt")
    sims = packed_cosines(need, "rt string, lt string")
    return texts.join(sims, ["lt", "rt"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0))).drop("lt", "rt")


def _known(p: Pass, pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs of a pass; those of an own pass are checked first: two columns l and r, no missing and no unknown IDs."""
    if type(p).__module__ == Pass.__module__:
        return pairs
    if set(pairs.columns) != {"l", "r"}:
        raise ValueError(f"pass {p.name!r} returns the columns l and r, not {pairs.columns}")
    pairs = Scratch(left.sparkSession, "pass").cut(pairs.select("l", "r").distinct())
    for side, df in (("l", left), ("r", right)):
        strange = pairs.select(side).distinct().join(df.select(F.col("_id").alias(side)), side, "left_anti")  # a null is in no table
        some = [r[0] for r in strange.limit(3).collect()]
        if some:
            raise ValueError(f"pass {p.name!r} proposes records that the {'left' if side == 'l' else 'right'} table lacks: {some}")
    return pairs


def _examples(p: Pass, left: DataFrame, right: DataFrame) -> str:
    """Some complete keys of either side, to show why none meet."""
    shown = []
    for name, df in zip(("left", "right"), p.keys(left, right)):
        made = [c for c in df.columns if c[:2] in ("_e", "_g") and c[2:].isdigit()]
        some = [" / ".join(r) for r in df.select(*made).distinct().limit(3).collect()]
        shown.append(f"{name} keys such as {', '.join(map(repr, some))}" if some else f"no complete key in the {name} table")
    return "; ".join(shown)


def _union(left: DataFrame, right: DataFrame, passes: list[Pass], a: list[str], b: list[str], max_pairs: int | None, unordered: bool, with_sim: bool = True) -> Candidates:
    if not isinstance(passes, list) or any(not isinstance(p, Pass) for p in passes):
        raise ValueError("`blockers` must be a list of blocking passes")
    if max_pairs is not None and (isinstance(max_pairs, bool) or not isinstance(max_pairs, int) or max_pairs < 0):
        raise ValueError("`max_pairs` is a whole number or None")
    proposals, marked = [_known(p, p.pairs(left, right), left, right) for p in passes], None
    for i, p in enumerate(proposals):
        one = p.select("l", "r", F.lit(1 << i).cast("long").alias("bit"))
        marked = one if marked is None else marked.unionByName(one)
    if unordered:
        marked = marked.where("l <> r").select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"), "bit")
    masks = marked.groupBy("l", "r").agg(F.bit_or("bit").alias("mask"))
    names = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(p.name)) for i, p in enumerate(passes)]
    frame = masks.select("l", "r", F.concat_ws("+", *names).alias("block"))
    if max_pairs is not None:
        masks = Scratch(left.sparkSession, "union").cut(masks)
        found = masks.limit(max_pairs + 1).count()
        if found > max_pairs:
            raise ValueError(f"the passes propose more than max_pairs={max_pairs:,} pairs; lower `k` or run a broad pass within a key")
        frame = masks.select("l", "r", F.concat_ws("+", *names).alias("block"))
    if with_sim:
        frame = pair_similarity(frame, left, right, a, b)
    frame = frame.withColumnsRenamed({"l": "left_id", "r": "right_id"}).select("left_id", "right_id", "block", *(["sim"] if with_sim else []))
    return Candidates(frame, masks, passes, proposals, max_pairs, left, right, unordered)


def candidates(left: DataFrame, right: DataFrame, *, on, blockers: list[Pass] | None = None, left_id: str, right_id: str, max_pairs: int | None = None, check: bool = True, with_sim: bool = True) -> Candidates:
    """The distinct pairs that the passes propose between two tables, the passes' names joined by + and the records' similarity.

    Without passes, the ten nearest by n-grams in either direction. ``max_pairs`` raises when the union is larger. Rows with a null ID
    are left out; ``check`` verifies that IDs are unique (one aggregation a side).
    """
    fields = parse_on(on, unpaired=True)
    a, b = [c for _, c in side_fields(fields, "left")], [c for _, c in side_fields(fields, "right")]
    check_columns(left, [*a, left_id], "left")
    check_columns(right, [*b, right_id], "right")
    if check:
        check_ids(left, left_id, "left")
        check_ids(right, right_id, "right")
    if blockers is None:
        if not any(f.left and f.right for f in fields):
            raise ValueError("the default passes need a field that both sides have; choose `blockers` yourself")
        blockers = default_passes(fields)
    left, right = (d.withColumn("_id", F.col(i)).where(F.col(i).isNotNull()) for d, i in ((left, left_id), (right, right_id)))
    return _union(left, right, blockers, a, b, max_pairs, False, with_sim)


def self_candidates(df: DataFrame, *, on, blockers: list[Pass] | None = None, id: str, max_pairs: int | None = None, check: bool = True, with_sim: bool = True) -> Candidates:
    """Pairs within one table: never a record with itself, each unordered pair once with the smaller ID first. Statistics count
    the table on both sides. The default pass takes eleven neighbours, as a record is its own nearest."""
    fields = parse_on(on)
    if any(f.left != f.right for f in fields):
        raise ValueError("within one table a field is a single column")
    columns = [f.left for f in fields]
    check_columns(df, [*columns, id], "deduplicated")
    if check:
        check_ids(df, id, "deduplicated")
    df = df.withColumn("_id", F.col(id)).where(F.col(id).isNotNull())
    return _union(df, df, blockers if blockers is not None else [ngrams(*columns, k=11)], columns, columns, max_pairs, True, with_sim)


def pairs_completeness(candidates: DataFrame, truth: DataFrame, unordered: bool = False) -> DataFrame:
    """One row: the share of distinct true pairs proposed, null without any."""

    def pairs(d):
        if unordered:
            return d.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()
        return d.select("left_id", "right_id").distinct()

    met = pairs(truth).join(pairs(candidates).withColumn("_in", F.lit(1)), ["left_id", "right_id"], "left")
    return met.agg(F.avg(F.coalesce("_in", F.lit(0))).alias("pairs_completeness"))


def union_candidates(*tables: DataFrame) -> DataFrame:
    """Several candidate tables as one: the first table's sim of each pair, and every block name once in order of the tables."""
    every = None
    for i, t in enumerate(tables):
        one = t.select("left_id", "right_id", "block", "sim", F.lit(i).alias("_t"))
        every = one if every is None else every.unionByName(one)
    names = F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("_t", "block"))), lambda x: F.split(x["block"], r"\+")))  # one entry a table and block
    return every.groupBy("left_id", "right_id").agg(F.array_join(F.array_distinct(names), "+").alias("block"), F.min_by("sim", "_t").alias("sim"))


def unproposed(df: DataFrame, id: str, candidates: DataFrame, side: str) -> DataFrame:
    """The records of one side without any candidate."""
    return df.join(candidates.select(F.col(side).alias(id)).distinct(), id, "left_anti")


def all_left(pairs: DataFrame, sample: DataFrame, id: str) -> DataFrame:
    """Pairs found on a whole left table, kept for a sample of its records."""
    return pairs.join(sample.select(F.col(id).alias("left_id")).distinct(), "left_id", "left_semi")


__all__ = ["Candidates", "NGrams", "all_left", "candidates", "pair_similarity", "pairs_completeness", "self_candidates", "union_candidates", "unproposed"]
