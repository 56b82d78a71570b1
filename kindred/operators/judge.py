"""Judging pairs: one probability a pair, from a column expression, a pandas function or an HTTP transport, under a budget."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.fields import check_columns, parse_on, side_fields
from kindred.functions.text import clean, normalize
from kindred.operators.resolve import probability
from kindred.ranking import running_sum
from kindred.scratch import Scratch
from kindred.skew import lookup_counted

# How saved scores name where a probability came from; "jev" is a judge's answer.
SOURCES = ("exact", "jev", "error", "unjudged")
STYLES = ("identity", "rule")
SCORE_SCHEMA = "p double, source string, error string, model string, provider string, score_origin string, answered_at double"


class FatalError(RuntimeError):
    """The judge cannot go on: a refused key or no credit. It ends the job; any other error belongs to its pair."""


def question(entity: str | None, definition: str = "", style: str = "identity") -> str:
    """The proposition put to the judge: that two records are the same entity, or that they satisfy a rule."""
    # The wording of the two propositions, so that cached answers stay comparable
    if style not in STYLES:
        raise ValueError(f"`style` must be one of {', '.join(STYLES)}; got {style!r}")
    definition = (definition or "").strip()
    if style == "rule":
        if not definition:
            raise ValueError('`style="rule"` needs a `definition`')
        return f"Record A and record B satisfy the following match rule. {definition}"
    if not entity or not entity.strip():
        raise ValueError("name the `entity` that the records describe")
    return f"Record A and record B refer to the same {entity.strip()}." + (f" {definition}" if definition else "")


def check_budget(budget: float | None) -> float:
    if budget is None:
        return math.inf
    if isinstance(budget, bool) or not isinstance(budget, (int, float)) or not math.isfinite(budget) or budget < 0:
        raise ValueError("a budget is zero or more, or None")
    return float(budget)


def records(df: DataFrame, id: str, fields: list[tuple[str, str]], out: str, key: str) -> DataFrame:
    """(out id, record, key) of one side: the record a judge sees as JSON without missing fields, and the normalized fields, null if any
    is empty."""
    shown = [clean(df, c).alias(label) for label, c in fields]
    norm = [normalize(clean(df, c)) for _, c in fields]
    whole = F.lit(True)
    for n in norm:
        whole = whole & (n != "")
    return df.select(F.col(id).alias(out), F.to_json(F.struct(*shown)).alias(f"{key}_record"), F.when(whole, F.concat_ws("\x1f", *norm)).alias(f"{key}_key"))


def states(candidates: DataFrame, left: DataFrame, right: DataFrame, on, left_id: str, right_id: str, ask: str, model: str = "", provider: str = "") -> DataFrame:
    """Candidates with both records and the state's hash: what is asked, of whom, about which two records."""
    fields = parse_on(on, unpaired=True)
    check_columns(left, [left_id, *(c for _, c in side_fields(fields, "left"))], "left")
    check_columns(right, [right_id, *(c for _, c in side_fields(fields, "right"))], "right")
    a, b = records(left, left_id, side_fields(fields, "left"), "left_id", "a"), records(right, right_id, side_fields(fields, "right"), "right_id", "b")
    candidates = Scratch(candidates.sparkSession, "states").kept(candidates)
    total = candidates.count()
    met = lookup_counted(lookup_counted(candidates, a, "left_id", "right_id", total=total), b, "right_id", "left_id", counted=candidates, total=total)
    return met.withColumn("state", F.sha2(F.concat_ws("\x1e", F.lit(provider), F.lit(model), F.lit(ask), "a_record", "b_record"), 256))


def budgeted(todo: DataFrame, budget: float, scratch: Scratch) -> DataFrame:
    """Adds within: whether the state is among the likeliest that the budget pays for. Distinct states are ranked by similarity and a
    running price decides, over one narrow row a state."""
    first = todo.groupBy("state").agg(F.max("sim").alias("sim"), F.min(F.struct("left_id", "right_id")).alias("at"), F.min("_price").alias("_price"))
    if math.isinf(budget):
        return first.select("state", F.lit(True).alias("within"))
    ordered = first.select("state", (-F.col("sim")).alias("_s"), F.col("at.left_id").alias("_l"), F.col("at.right_id").alias("_r"), "_price")
    return running_sum(ordered, ["_s", "_l", "_r"], F.col("_price"), "_spent", scratch).select("state", (F.round("_spent", 9) <= budget).alias("within"))


class ColumnJudge:
    """A judge that is an expression over sim, a_record, b_record and the candidates' columns; it stays in the JVM."""

    name, provider = "column", "local"

    def __init__(self, p: Column, name: str = "column"):
        self.p, self.name = p, name

    def answer(self, asked: DataFrame) -> DataFrame:
        return asked.withColumn("_p", self.p.cast("double")).withColumn("_e", F.lit(None).cast("string")).select("state", "_p", "_e")


class PandasJudge:
    """A judge over Arrow batches: ``fn(frame) -> series of p`` with columns a_record, b_record and sim."""

    provider = "local"

    def __init__(self, fn: Callable[[pd.DataFrame], pd.Series], name: str = "pandas"):
        self.fn, self.name = fn, name

    def answer(self, asked: DataFrame) -> DataFrame:
        fn = self.fn

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"state": b["state"], "_p": pd.Series(fn(b), dtype="float64").to_numpy(), "_e": None})

        return asked.mapInPandas(run, "state string, _p double, _e string")


class HttpJudge:
    """A judge behind a transport: ``transport(body) -> p`` with body = {record_a, record_b, question}; ``concurrency`` in flight a task.

    An ordinary exception is the pair's error; FatalError ends the job."""

    def __init__(self, transport: Callable[[dict], float], ask: str, name: str = "http", provider: str = "http", concurrency: int = 32):
        self.transport, self.ask, self.name, self.provider, self.concurrency = transport, ask, name, provider, concurrency

    def answer(self, asked: DataFrame) -> DataFrame:
        transport, ask, width = self.transport, self.ask, self.concurrency

        def one(row) -> tuple:
            try:
                return row[0], float(transport({"record_a": json.loads(row[1]), "record_b": json.loads(row[2]), "question": ask})), None
            except FatalError:
                raise
            except Exception as error:
                return row[0], None, str(error)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(width) as pool:
                for b in batches:
                    yield pd.DataFrame(list(pool.map(one, zip(b["state"], b["a_record"], b["b_record"]))), columns=["state", "_p", "_e"])

        return asked.mapInPandas(run, "state string, _p double, _e string")


class JsonTransport:
    """POSTs {model, record_a, record_b, question} to an address and reads ``field`` of the JSON answer as the probability.

    A busy or failing server (429, 5xx, no connection) is asked again ``retries`` times, waiting longer each time, or as long as it
    asks for. A refused key or missing credit (401, 402, 403) ends the job; any other refusal is the pair's error. The key comes from
    the environment variable named ``key_env`` of the executor, never from the plan."""

    def __init__(self, url: str, model: str, field: str = "p", key_env: str = "JUDGE_API_KEY", retries: int = 4, timeout: float = 60.0, wait: float = 0.5):
        self.url, self.model, self.field, self.key_env, self.retries, self.timeout, self.wait = url, model, field, key_env, retries, timeout, wait

    def __call__(self, body: dict) -> float:
        import os
        import time
        import urllib.error
        import urllib.request

        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[self.key_env]}"} if os.environ.get(self.key_env) else {})
        data = json.dumps({"model": self.model} | body).encode()
        for turn in range(self.retries + 1):
            pause = self.wait * 2**turn
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, data, head), timeout=self.timeout) as answer:
                    p = float(json.load(answer)[self.field])
                if not 0 <= p <= 1:
                    raise ValueError(f"the answer {p!r} is no probability")
                return p
            except urllib.error.HTTPError as error:
                if error.code in (401, 402, 403):
                    raise FatalError(f"{self.url} refuses: {error}") from None
                if error.code != 429 and error.code < 500 or turn == self.retries:
                    raise
                asked = error.headers.get("Retry-After", "")
                pause = max(pause, float(asked)) if asked.isdigit() else pause
            except (urllib.error.URLError, TimeoutError):
                if turn == self.retries:
                    raise
            time.sleep(pause)
        raise AssertionError("not reached")


def read_cache(spark, path: str) -> DataFrame | None:
    """The answers kept under a path, None if there are none yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def add_to_cache(found: DataFrame, path: str) -> None:
    """Append answers to the cache; when a state was answered twice, the first one met holds for later runs."""
    known = read_cache(found.sparkSession, path)
    new = found if known is None else found.join(known.select("state"), "state", "left_anti")
    new.write.mode("append").parquet(path)


def judge(candidates: DataFrame, left: DataFrame, right: DataFrame, judge, *, on, left_id: str, right_id: str, entity: str | None = None, definition: str = "", style: str = "identity", budget: float | None = 5.0, price: float = 0.0, cache: DataFrame | None = None, exact_shortcut: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Scores: candidates with p, source (exact, jev, error, unjudged), error, model, provider, score_origin and answered_at.

    Equal states are asked once and shared; states in ``cache`` (state, p, answered_at) cost nothing; the budget goes to the likeliest of
    the rest, each at ``price``. Budget 0 answers from exact pairs and the cache only.
    """
    ask, limit = question(entity, definition, style), check_budget(budget)
    scratch = scratch or Scratch(candidates.sparkSession, "judge")
    fields = parse_on(on, unpaired=True)
    if exact_shortcut and any(not (f.left and f.right) for f in fields):
        raise ValueError("`exact_shortcut` needs fields that both sides have")
    full = states(candidates, left, right, on, left_id, right_id, ask, judge.name, judge.provider)
    same = (F.col("a_key") == F.col("b_key")) if exact_shortcut else F.lit(False)
    full = scratch.cut(full.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("_price", F.lit(float(price))))
    kept = full
    if cache is not None:
        known = cache.select("state", F.col("p").alias("_cp"), F.col("answered_at").alias("_ct")).dropDuplicates(["state"])
        kept = kept.join(known, "state", "left")
    else:
        kept = kept.withColumn("_cp", F.lit(None).cast("double")).withColumn("_ct", F.lit(None).cast("double"))
    todo = kept.where(~F.col("_same") & F.col("_cp").isNull())
    pay = budgeted(todo, limit, scratch)
    one = todo.groupBy("state").agg(F.min(F.struct("left_id", "right_id")).alias("_at"), F.first("a_record").alias("a_record"), F.first("b_record").alias("b_record"), F.max("sim").alias("sim"))
    answered = scratch.cut(judge.answer(one.join(pay.where("within").select("state"), "state").select("state", "a_record", "b_record", "sim")).join(one.select("state", "_at"), "state"))
    now = F.unix_micros(F.current_timestamp()) / 1e6
    out = kept.join(answered.select("state", "_p", "_e", "_at"), "state", "left")
    asked = F.col("_at").isNotNull() & ~F.col("_same") & F.col("_cp").isNull()
    mine = (F.col("_at.left_id") == F.col("left_id")) & (F.col("_at.right_id") == F.col("right_id"))
    source = F.when(F.col("_same"), "exact").when(F.col("_cp").isNotNull(), "jev").when(asked & F.col("_e").isNotNull(), "error").when(asked & probability(F.col("_p")).isNotNull(), "jev").otherwise("unjudged")
    out = out.withColumn("source", source).withColumn("p", F.when(F.col("_same"), F.lit(1.0)).when(F.col("_cp").isNotNull(), F.col("_cp")).when(asked & F.col("_e").isNull(), probability(F.col("_p"))))
    by = F.col("source") == "jev"
    return out.select(
        *candidates.columns, "p", "source", F.when(F.col("source") == "error", F.col("_e")).alias("error"), F.when(by, F.lit(judge.name)).alias("model"), F.when(by, F.lit(judge.provider)).alias("provider"),
        F.when(by, F.when(F.col("_cp").isNotNull(), "cache").when(mine, "api").otherwise("shared")).alias("score_origin"), F.when(by, F.coalesce("_ct", now)).alias("answered_at"),
    )


def answers(scores: DataFrame, left: DataFrame, right: DataFrame, on, left_id: str, right_id: str, ask: str, model: str = "", provider: str = "") -> DataFrame:
    """(state, p, answered_at) of judged pairs: a cache for later runs, to be kept as a table."""
    s = states(scores.where("source = 'jev'"), left, right, on, left_id, right_id, ask, model, provider)
    return s.groupBy("state").agg(F.max_by("p", "answered_at").alias("p"), F.max("answered_at").alias("answered_at"))


def todo(scores: DataFrame) -> DataFrame:
    """Pairs that a resumed run asks again: unjudged and failed ones."""
    return scores.where(F.col("source").isin("unjudged", "error"))


def report_warnings(scores: DataFrame) -> None:
    n = {r["source"]: r["count"] for r in scores.groupBy("source").count().collect()}
    if n.get("unjudged"):
        warnings.warn(f"the budget ran out with {n['unjudged']:,} pairs unjudged; raise `budget` to judge more", stacklevel=2)
    if n.get("error"):
        warnings.warn(f"{n['error']:,} pairs failed and have no probability", stacklevel=2)


def pair_tokens(full: DataFrame, ask: str, sample: int = 200) -> DataFrame:
    """One row: tokens, the mean over a hash-ordered sample of pairs, at four characters a token. ``full`` is what ``states`` returns."""
    size = F.ceil((F.length("a_record") + F.length("b_record") + F.lit(len(ask) + 60)) / 4)
    return full.select(size.alias("t"), "state").orderBy("state").limit(sample).agg(F.avg("t").alias("tokens"))
