"""Record linkage and deduplication on Spark."""

__version__ = "0.2.0"

from kindred.operators import judge as judges  # noqa: E402
from kindred.operators import passes  # noqa: E402
from kindred.operators.audit import Evaluation, audit_sample, evaluate, score_against_truth  # noqa: E402
from kindred.operators.cluster import cluster  # noqa: E402
from kindred.operators.judge import judge  # noqa: E402
from kindred.operators.resolve import resolve  # noqa: E402
from kindred.operators.review import Review, ReviewedLinks, create_review, read_review  # noqa: E402
from kindred.plans.linker import DedupeResult, Linker, Result, dedupe, link, load  # noqa: E402

__all__ = [
    "DedupeResult", "Evaluation", "Linker", "Result", "Review", "ReviewedLinks", "audit_sample", "cluster", "create_review", "dedupe", "evaluate", "judge", "judges", "link", "load", "passes", "read_review",
    "resolve", "score_against_truth",
]
