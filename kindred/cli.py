"""Command line: link, resume, dedupe, cluster, estimate, audit, evaluate, review. Runs under spark-submit or plain Python."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import passes as P
from kindred.operators.audit import audit_sample, evaluate
from kindred.operators.cluster import cluster, cluster_links
from kindred.operators.judge import ColumnJudge, HttpJudge, JsonTransport, add_to_cache, question, read_cache
from kindred.operators.resolve import HOW
from kindred.operators.review import create_review, read_review
from kindred.plans.linker import Linker, load
from kindred.ranking import place
from kindred.scratch import Scratch
from kindred.sources.tables import read_table, stata_value_labels, write_table

_WINDOW = re.compile(r"(?:(?P<low>[+-]?\d+(?:\.\d+)?)\.\.(?P<high>[+-]?\d+(?:\.\d+)?)|(?P<tol>\d+(?:\.\d+)?))(?P<unit>[wdhms])?")


def column(text: str, unpaired: bool = False):
    """name, left=right, and for compared fields also left= and =right."""
    a, eq, b = text.partition("=")
    if not eq and a.strip():
        return a
    if "=" in b or not (a.strip() or b.strip()) or (not unpaired and not (a.strip() and b.strip())):
        raise ValueError(f"column {text!r}: use name or left=right")
    return (a or None, b or None)


def block_rule(text: str, date_format=None) -> P.Pass:
    """A pass from a rule: exact:a+b, ngrams:a:k, ngrams-reverse:a:k, embeddings:a:k, initials:a, window:l=r:lo..hi[wdhms] or window:a:t, within:cols:RULE."""
    kind, _, rest = text.partition(":")
    cols, _, option = rest.partition(":")
    try:
        names = [column(c) for c in cols.split("+")]
        if kind == "exact" and not option:
            return P.exact(*names)
        if kind == "initials" and not option and len(names) == 1:
            return P.initials(names[0])
        if kind in ("ngrams", "ngrams-reverse") and (not option or option.isdigit()):
            return P.ngrams(*names, k=int(option or 10), reverse=kind == "ngrams-reverse")
        if kind == "embeddings" and (not option or option.isdigit()):
            return P.embeddings(*names, k=int(option or 10))
        if kind == "window" and len(names) == 1 and (m := _WINDOW.fullmatch(option)):
            bounds = {"tolerance": float(m["tol"])} if m["tol"] else {"between": (float(m["low"]), float(m["high"]))}
            return P.window(names[0], unit=m["unit"], date_format=date_format if m["unit"] else None, **bounds)
        if kind == "within" and option:
            return P.within(block_rule(option, date_format), *names)
    except ValueError as error:
        raise ValueError(f"--block {text!r}: {error}") from None
    raise ValueError(f"--block {text!r}: use exact:COLS, ngrams:COLS:K, ngrams-reverse:COLS:K, embeddings:COL:K, initials:COL, window:COL:RANGE or within:COLS:RULE")


def date_formats(text: str | None):
    if not text:
        return None
    a, eq, b = text.partition("=")
    return (a or None, b or None) if eq else text


def safe_outputs(inputs: list[str], outputs: list[str | None]) -> None:
    """No output may be an input or another output."""
    seen = {os.path.realpath(p) for p in inputs if p}
    for path in filter(None, outputs):
        real = os.path.realpath(path)
        if real in seen:
            raise ValueError(f"{path} is an input or is written twice")
        seen.add(real)


def _id(df: DataFrame, name: str | None) -> tuple[DataFrame, str]:
    if name:
        return df, name
    # row numbers from 0 in the order of the file, written once so that every later read sees the same ones
    scratch = Scratch(df.sparkSession, "rows")
    rows = scratch.cut(df.withColumn("_at", F.monotonically_increasing_id()))
    return scratch.cut(place(rows, ["_at"], "_row", scratch).withColumn("_row", F.col("_row") - 1).drop("_at")), "_row"


def _emit(df: DataFrame, path: str | None) -> None:
    if path:
        write_table(df, path)
        return
    import csv

    out = csv.writer(sys.stdout, lineterminator="\n")
    out.writerow(df.columns)
    for row in df.toLocalIterator():
        out.writerow(["" if v is None else v for v in row])


def _rules(args) -> list[P.Pass] | None:
    return [block_rule(b, date_formats(args.date_format)) for b in args.block] if args.block else None


def _judge(args, ask: str = ""):
    if getattr(args, "api", None):
        return HttpJudge(JsonTransport(args.api, args.model), ask, args.model, args.api, args.jobs)
    return ColumnJudge(F.expr(args.judge), name=args.judge)


def _budget(text: str | None):
    return None if text in (None, "none") else float(text)


def _link(spark, args) -> None:
    safe_outputs([args.left, args.right], [args.output, args.scores, args.report])
    rules = _rules(args)
    left, lid = _id(read_table(spark, args.left), args.left_id)
    right, rid = _id(read_table(spark, args.right), args.right_id)
    linker = Linker(_judge(args, question(args.entity, args.define, args.style)), [column(c, True) for c in args.on], args.entity, args.define, rules, args.style, args.exact_shortcut, max_pairs=args.max_pairs)
    if args.command == "estimate" or args.estimate:
        for k, v in linker.estimate(left, right, left_id=lid, right_id=rid).items():
            print(f"{k}: {v}")
        return
    result = linker.link(left, right, left_id=lid, right_id=rid, how=args.how, threshold=args.threshold, min_margin=args.min_margin, budget=_budget(args.budget), cache=_cache(spark, args))
    _keep(result, args)
    _finish(result, result.links, args)


def _cache(spark, args) -> DataFrame | None:
    return read_cache(spark, args.cache) if getattr(args, "cache", None) and not args.no_cache else None


def _keep(result, args) -> None:
    if getattr(args, "cache", None) and not args.no_cache:
        add_to_cache(result.answers(), args.cache)


def _finish(result, main: DataFrame, args) -> None:
    _emit(main, args.output)
    if getattr(args, "scores", None):
        write_table(result.scores, args.scores)
    if getattr(args, "save", None):
        result.save(args.save)
    if getattr(args, "report", None):
        with open(args.report, "w", encoding="utf-8") as f:
            f.write(result.report() + "\n\n" + result.methods() + "\n")


def _resume(spark, args) -> None:
    safe_outputs([args.left, args.right, args.run], [args.output, args.save])
    run = load(spark, args.run)
    result = run.resume(read_table(spark, args.left), read_table(spark, args.right), judge_with=_judge(args), budget=_budget(args.budget))
    result.save(args.save or args.run.rstrip("/") + "-resumed")
    _emit(result.links, args.output)


def _dedupe(spark, args) -> None:
    safe_outputs([args.table], [args.output, args.scores, args.links, args.report])
    df, key = _id(read_table(spark, args.table), args.id)
    result = Linker(_judge(args, question(args.entity, args.define, args.style)), [column(c) for c in args.on], args.entity, args.define, _rules(args), args.style, args.exact_shortcut, max_pairs=args.max_pairs).dedupe(df, id=key, threshold=args.threshold, linkage=args.linkage, unproposed=args.unproposed, budget=_budget(args.budget), cache=_cache(spark, args))
    _keep(result, args)
    if args.links:
        write_table(result.links, args.links)
    _finish(result, result.clusters, args)


def _typed(scores: DataFrame) -> DataFrame:
    return scores.withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("p", "sim", "margin", "weight") if c in scores.columns})


def _cluster(spark, args) -> None:
    safe_outputs([args.scores, args.records], [args.output, args.links])
    scores = _typed(read_table(spark, args.scores))
    ids = read_table(spark, args.records) if args.records else None
    found = cluster(scores, ids=ids, id=args.id, threshold=args.threshold, linkage=args.linkage, unproposed=args.unproposed, check=True)
    if args.links:
        write_table(cluster_links(scores, found), args.links)
    _emit(found, args.output)


def _audit(spark, args) -> None:
    safe_outputs([args.scores, args.links, args.left, args.right], [args.output])
    more = {"left": read_table(spark, args.left), "right": read_table(spark, args.right), "on": [column(c, True) for c in args.on], "left_id": args.left_id, "right_id": args.right_id} if args.left else {}
    links = read_table(spark, args.links) if args.links else None
    write_table(audit_sample(_typed(read_table(spark, args.scores)), n=args.n, seed=args.seed, links=links, **more), args.output, safe=True)


def _evaluate(spark, args) -> None:
    labels = _typed(read_table(spark, args.labeled))
    if args.labeled.lower().endswith(".dta"):
        # Stata keeps the bins' names as labels of codes
        names = {str(k): str(v) for k, v in stata_value_labels(args.labeled, "bin").items()}
        if names:
            code = F.regexp_replace(F.col("bin").cast("string"), r"\.0$", "")
            labels = labels.withColumn("bin", F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in names.items()], code))
    found = evaluate(labels, threshold=args.threshold, mode=args.mode)
    print(found.to_markdown() if args.markdown else found.summary())


def _review(spark, args) -> None:
    safe_outputs([args.source, args.left, args.right], [args.output])
    if args.action == "create":
        create_review(load(spark, args.source), left=read_table(spark, args.left), right=read_table(spark, args.right)).save(args.output)
    elif args.action == "page":
        read_review(args.source).write_html(args.output)
    else:
        read_review(args.source).reviewed(spark, how=args.how).write(args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kindred", description="Link and deduplicate records on Spark.")
    sub = top.add_subparsers(dest="command", required=True)

    def common(p, judged: bool = True) -> None:
        p.add_argument("--on", action="append", required=True, help="field to compare; repeat for more")
        p.add_argument("--block", action="append", help="blocking rule; repeat for more")
        p.add_argument("--date-format", help="strptime format of window rules, or LEFT=RIGHT")
        p.add_argument("--entity")
        p.add_argument("--define", default="", help="the match rule in words")
        p.add_argument("--style", choices=("identity", "rule"), default="identity")
        p.add_argument("--judge", default="sim", help="SQL expression of the probability over sim, a_record, b_record")
        p.add_argument("--api", help="address of a model to ask instead of --judge")
        p.add_argument("--model", default="model", help="the model's name")
        p.add_argument("-j", "--jobs", type=int, default=32, help="questions in flight a task")
        p.add_argument("--cache", help="folder that keeps answers for later runs")
        p.add_argument("--no-cache", action="store_true")
        p.add_argument("--budget", default="none")
        p.add_argument("--max-pairs", type=int, default=5_000_000)
        p.add_argument("--exact-shortcut", action="store_true")
        p.add_argument("--estimate", action="store_true")
        p.add_argument("--threshold", type=float, default=0.5)
        for name in ("--scores", "--save", "--report"):
            p.add_argument(name)
        p.add_argument("-o", "--output")

    def grouping(p) -> None:
        p.add_argument("--linkage", choices=("average", "components"), default="average")
        p.add_argument("--unproposed", choices=("nonmatch", "ignore"), default="nonmatch")

    for name in ("link", "estimate"):
        p = sub.add_parser(name)
        p.add_argument("left")
        p.add_argument("right")
        common(p)
        p.add_argument("--left-id")
        p.add_argument("--right-id")
        p.add_argument("--how", choices=HOW, default="one-to-one")
        p.add_argument("--min-margin", type=float)
        p.set_defaults(run=_link)
    p = sub.add_parser("resume")
    for x in ("run", "left", "right"):
        p.add_argument(x if x != "run" else "run_dir")
    p.add_argument("--judge", default="sim")
    p.add_argument("--budget", default="none")
    p.add_argument("--save")
    p.add_argument("-o", "--output")
    p.set_defaults(run=lambda spark, a: (setattr(a, "run", a.run_dir), _resume(spark, a)))
    p = sub.add_parser("dedupe")
    p.add_argument("table")
    common(p)
    grouping(p)
    p.add_argument("--id")
    p.add_argument("--links")
    p.set_defaults(run=_dedupe)
    p = sub.add_parser("cluster")
    p.add_argument("scores")
    p.add_argument("--records")
    p.add_argument("--id")
    p.add_argument("--threshold", type=float, default=0.5)
    grouping(p)
    p.add_argument("--links")
    p.add_argument("-o", "--output")
    p.set_defaults(run=_cluster)
    p = sub.add_parser("audit")
    p.add_argument("scores")
    for x in ("--links", "--left", "--right", "--left-id", "--right-id"):
        p.add_argument(x)
    p.add_argument("--on", action="append")
    p.add_argument("-n", type=int, default=200)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("-o", "--output", required=True)
    p.set_defaults(run=_audit)
    p = sub.add_parser("evaluate")
    p.add_argument("labeled")
    p.add_argument("--mode", choices=("threshold", "selected"), default="threshold")
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--markdown", action="store_true")
    p.set_defaults(run=_evaluate)
    p = sub.add_parser("review")
    p.add_argument("action", choices=("create", "page", "apply"))
    p.add_argument("source")
    p.add_argument("--left")
    p.add_argument("--right")
    p.add_argument("--how", choices=HOW)
    p.add_argument("-o", "--output", required=True)
    p.set_defaults(run=_review)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
        for rule in getattr(args, "block", None) or []:
            block_rule(rule, date_formats(args.date_format))  # before any data is read
        args.run(spark or SparkSession.builder.getOrCreate(), args)
        return 0
    except (ValueError, OSError) as error:
        print(f"kindred: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
