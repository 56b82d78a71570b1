"""Benchmark runs: string baselines and a judge on one dataset, thresholds from dev entities, measures on test entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import baselines as B
from kindred.operators.audit import score_against_truth
from kindred.operators.candidates import candidates, pairs_completeness

METHODS = {"exact": B.exact_matches, "jaro_winkler": B.jaro_winkler_matches, "tfidf": B.tfidf_matches}


def in_sample(left: DataFrame, right: DataFrame, truth: DataFrame, *, on, left_id: str, right_id: str) -> list[dict]:
    """One row a baseline: its best threshold on the whole truth and what it reaches there."""
    rows = []
    for name, method in METHODS.items():
        best = B.tune_threshold(method(left, right, on=on, left_id=left_id, right_id=right_id), truth).first()
        rows.append({"method": name} | (best.asDict() if best else {"threshold": None, "links": 0, "tp": 0, "precision": None, "recall": 0.0, "f1": 0.0}))
    return rows


def blocking(left: DataFrame, right: DataFrame, truth: DataFrame, *, on, left_id: str, right_id: str, blockers=None) -> dict:
    """Candidate pairs of the passes and the share of the truth among them."""
    pairs = candidates(left, right, on=on, blockers=blockers, left_id=left_id, right_id=right_id, with_sim=False).frame.persist()
    out = {"pairs": pairs.count(), "completeness": pairs_completeness(pairs, truth).first()[0]}
    pairs.unpersist()
    return out


def held_out(scores: dict[str, DataFrame], parts: DataFrame, truth: DataFrame, how: str = "many-to-one") -> list[dict]:
    """One row a method: the threshold chosen on dev records, and precision, recall and F1 on test records. parts is entity_split()."""
    from kindred.operators.resolve import resolve

    def only(df: DataFrame, part: str) -> DataFrame:
        for side in ("left", "right"):
            ids = parts.where((F.col("side") == side) & (F.col("part") == part)).select(F.col("id").alias("_id"))
            df = df.join(ids, F.col(f"{side}_id").cast("string") == F.col("_id"), "left_semi")
        return df

    rows = []
    for name, s in scores.items():
        chosen = B.choose_threshold(only(s, "dev"), only(truth, "dev"), how).first()
        links = resolve(only(s, "test"), how=how, threshold=chosen["threshold"])
        got = score_against_truth(links, only(truth, "test"), empty=0.0).first()
        rows.append({"method": name, "threshold": chosen["threshold"]} | {k: got[k] for k in ("tp", "fp", "fn", "precision", "recall", "f1")})
    return rows


def markdown(rows: list[dict]) -> str:
    """Rows as a Markdown table; numbers with four places."""
    if not rows:
        return ""
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = list(rows[0])
    return "\n".join([f"| {' | '.join(head)} |", "|" + "---|" * len(head), *(f"| {' | '.join(show(r.get(c)) for c in head)} |" for r in rows)])
