"""Reading difficulty by harmonic propagation over the graph of documents and words (problem 9).

Documents and words are the nodes of a bipartite graph; an edge weighs how often the document uses the word. Graded documents
are clamped to their grade, every other node takes the weighted mean of its neighbours, and the iterations run until the words
stop moving. A word's difficulty thus comes from all documents that use it, graded or not, in whatever language.

A document's edges never move: they lie in one row as packed arrays, written once. An iteration scans these rows, computes the
documents' values from the words' values, and adds up the words' new sums inside each partition, so that only one vector a
partition is shuffled and merged. Words are hashed to 2**WORD_BITS nodes, which bounds every vector at any corpus size.

The cut between two bands is fitted on held-out grades: two further channels of the same iterations clamp only every second
graded document, and the values of the documents left out give the cut of fewest errors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.scratch import Scratch

WORD_BITS = 18
#: A guard far above need: SETTLED ends the iterations, and ROUNDS without it raises.
ROUNDS = 100
#: Stop when the mean word moved less than this share of the scale.
SETTLED = 0.002
#: Weight, in words, of the overall mean in every node: it settles nodes that hardly touch the graded ones.
PRIOR = 2.0
LEAN = 0.02
STEPS = 20
#: The languages told apart are those with grades enough for cuts of their own, ENOUGH on either side, and the TONGUES most frequent
#: others, which only keep their texts from being taken for one of these. Codes have two letters, so there are never more than 676.
TONGUES, ENOUGH = 24, 4
CHANNELS = 3
SLICE = 1 << 14
#: A character of a script written without spaces is a word by itself.
UNSPACED = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\u0e00-\u0e7f"
WORD = re.compile(rf"[{UNSPACED}]|[^\W\d_{UNSPACED}]+")
#: What counts as running prose: words enough, mostly of letters, not one passage over and over, with words known from graded prose.
LEAST_WORDS = 12
LEAST_LETTERS = 0.6
TOKEN_CACHE = 300_000


class _Nodes(dict):
    def __missing__(self, word: str) -> int:
        n = zlib.crc32(word.encode("utf-8", "replace")) & ((1 << WORD_BITS) - 1)
        if len(self) >= TOKEN_CACHE:
            self.clear()
        if len(word) < 64:
            self[word] = n
        return n


_NODES = _Nodes()


def edges(docs: DataFrame, key: str, text: str, carry: str) -> DataFrame:
    """(key, carry, nodes, times, letters, n): the packed word nodes of each document and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, times, letters, count = [], [], [], []
            for t in batch.column(1).to_pylist():
                ws = WORD.findall(t.lower()) if t else []
                ids, n = np.unique(np.fromiter(map(_NODES.__getitem__, ws), np.int32, len(ws)), return_counts=True)
                nodes.append(ids.astype(np.int32).tobytes())
                times.append(n.astype(np.float32).tobytes())
                count.append(len(ws))
                letters.append((sum(map(len, ws)) + len(ws)) / max(1, len(t)) if t else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(times, pa.binary()), pa.array(letters, pa.float64()), pa.array(count, pa.int64())],
                names=[key, carry, "nodes", "times", "letters", "n"],
            )

    src = docs.select(F.col(key), F.col(text).cast("string").alias("_t"), F.col(carry)).where(F.col(key).isNotNull())
    return src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, `{carry}` string, nodes binary, times binary, letters double, n bigint")


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed arrays, and how many each row has."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, kind, (int(at[-1]) - int(at[0])) // 4, int(at[0])) if data is not None and at[-1] > at[0] else np.empty(0, kind)), np.diff(at) // 4


def _values(batch: pa.RecordBatch, words: np.ndarray, known: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a batch: all nodes, each edge's share of its document and row, the documents' values by channel, and the share of
    their words that the graded documents reach."""
    nodes, lens = _flat(batch.column("nodes"), np.int32)
    times, _ = _flat(batch.column("times"), np.float32)
    n = len(lens)
    row = np.repeat(np.arange(n), lens)
    w = times * known[nodes]
    reached, total = np.bincount(row, w, n), np.bincount(row, times, n)
    value = np.stack([(np.bincount(row, w * words[c][nodes], n) + PRIOR * mean[c]) / (reached + PRIOR) for c in range(CHANNELS)])
    total = np.maximum(total, 1)
    return nodes, times / total[row], row, value, reached / total


def propagate(graph: DataFrame, key: str, tongues: list[str], rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(words, known, mean, lean) after the iterations. graph has edges(), grade (null without), fold (0 or 1) and tongue (the
    number of the document's language, null where unknown).

    words is (CHANNELS, 2**WORD_BITS); channel 0 clamps all grades, channels 1 and 2 those of one fold. known weighs a word by
    how well graded documents reach it; lean is how a word is spread over the languages."""
    spark = graph.sparkSession
    size = 1 << WORD_BITS
    row = graph.where("grade is not null").agg(*[F.avg(F.when(c, F.col("grade"))) for c in (F.lit(True), F.col("fold") == 0, F.col("fold") == 1)]).first()
    mean = np.array([x if x is not None else (row[0] or 0.0) for x in row], np.float64)
    words = np.repeat(mean[:, None], size, 1).astype(np.float32)
    known = np.zeros(size, np.float32)
    spread = np.zeros((len(tongues), size), np.float32)
    schema = "slice int, part int, data binary"
    for step in range(rounds):
        shared = spark.sparkContext.broadcast((words, known, mean))
        extra = len(tongues) if step == 0 else 0
        high = 2 * CHANNELS + extra

        def sums(batches: Iterator[pa.RecordBatch], shared=shared, step=step, extra=extra, high=high) -> Iterator[pa.RecordBatch]:
            words, known, mean = shared.value
            # per node: the sum of values by channel, the weight by channel, and in the first round the weight by language
            acc = np.zeros((high, size), np.float64)
            seen = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                nodes, share, row, value, reach = _values(batch, words, known, mean)
                grade = batch.column("grade").to_numpy(zero_copy_only=False).astype(np.float64)
                fold = np.nan_to_num(batch.column("fold").to_numpy(zero_copy_only=False).astype(np.float64), nan=-1)
                seen += len(nodes)
                for c in range(CHANNELS):
                    use = ~np.isnan(grade) & ((c == 0) | (fold == c - 1))
                    conf = np.where(use, 1.0, reach * reach)[row] * share
                    acc[c] += np.bincount(nodes, conf * np.where(use, grade, value[c])[row], size)
                    acc[CHANNELS + c] += np.bincount(nodes, conf, size)
                if extra:
                    tongue = np.nan_to_num(batch.column("tongue").to_numpy(zero_copy_only=False).astype(np.float64), nan=-1)[row]
                    for t in range(extra):
                        acc[2 * CHANNELS + t] += np.bincount(nodes[tongue == t], share[tongue == t], size)
            if not seen:
                return
            part = int(zlib.crc32(acc[CHANNELS].tobytes())) % 64
            rows = [(k, acc[:, k * SLICE : (k + 1) * SLICE].astype(np.float32)) for k in range(size // SLICE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([x.tobytes() for _, x in rows], pa.binary())], names=["slice", "part", "data"]
            )

        def add(pdf):
            import pandas as pd

            if not len(pdf):
                return pdf
            total = None
            for x in sorted(pdf["data"]):  # a fixed order, so the sums do not depend on which task came first
                x = np.frombuffer(x, np.float32).astype(np.float64)
                total = x if total is None else total + x
            return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "part": [0], "data": [total.astype(np.float32).tobytes()]})

        src = graph.select("nodes", "times", "grade", "fold", *(["tongue"] if extra else []))
        merged = src.mapInArrow(sums, schema).groupBy("slice", "part").applyInPandas(add, schema).groupBy("slice").applyInPandas(add, schema)
        acc = np.zeros((high, size), np.float32)
        for r in merged.toLocalIterator():  # one vector of fixed length
            acc[:, r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["data"], np.float32).reshape(high, -1)
        if extra:
            spread = acc[2 * CHANNELS :] / np.maximum(acc[2 * CHANNELS :].sum(0), 1e-6)
        weight = acc[CHANNELS : 2 * CHANNELS]
        new = (acc[:CHANNELS] + LEAN * mean[:, None].astype(np.float32)) / (weight + LEAN)
        moved = float(np.abs(new - words)[:, weight[0] > 0].mean()) if (weight[0] > 0).any() else 0.0
        words, known = new.astype(np.float32), (weight[0] / (weight[0] + LEAN)).astype(np.float32)
        shared.unpersist()
        if step and moved < SETTLED:
            return words, known, mean, spread
    raise RuntimeError(f"the words still move by {moved:.4f} after {rounds} rounds")


def _cut(held: list[tuple[float, bool]], crowd: dict[int, int]) -> float:
    """The value that parts the held-out documents: of the cuts with about the fewest errors, the one where the fewest documents
    of the whole corpus lie. crowd counts documents by steps of 1/STEPS."""
    up, down = np.sort([v for v, y in held if y]), np.sort([v for v, y in held if not y])
    if not len(up):
        return float("inf")
    if not len(down):
        return float("-inf")
    at = np.arange(-6 * STEPS, 6 * STEPS + 1)
    cuts = at / STEPS
    errors = np.searchsorted(up, cuts) + len(down) - np.searchsorted(down, cuts)
    close = np.array([sum(crowd.get(int(i) + d, 0) * w for d, w in ((-3, 1), (-2, 2), (-1, 3), (0, 3), (1, 2), (2, 1))) for i in at], float)
    fine = np.flatnonzero(errors <= errors.min() + 0.015 * len(held))
    fine = fine[close[fine] <= close[fine].min()]
    return float(cuts[fine[len(fine) // 2]])


def reading_levels(
    docs: DataFrame, key: str, text: str, lang: str, labels: DataFrame, label_key: str, band: str, bands: list[str], rounds: int = ROUNDS, fit_rows: int = 50_000
) -> DataFrame:
    """(key, difficulty, level, prose) of every document with a key: difficulty on the scale 0 to len(bands) - 1, level the
    name of the band, prose whether the text is running prose.

    Grades are the mean of a document's readers; null bands and bands of other names are no grades. The cuts between bands are
    fitted on at most fit_rows held-out grades, taken by hash (a documented bound); everything else covers all rows. The column
    lang may be null, wrong or in another notation: a text's language is the one that its words have in the corpus. A language
    with too few grades takes the cuts of all languages, on values brought to one mean and spread. A null, empty or wordless
    text has the mean difficulty and is no prose. A graded document keeps its readers' grade as its difficulty, and the band they agree
    on; where they differ, the graph chooses between the bands they named. Repeated keys stay repeated. Without grades all difficulties are 0 and no
    document is above the lowest band.
    """
    scratch = Scratch(docs.sparkSession, "reading")
    grade = F.coalesce(*[F.when(F.lower(F.trim(band)) == b, F.lit(float(i))) for i, b in enumerate(bands)])
    grades = labels.select(F.col(label_key).alias(key), grade.alias("g")).where("g is not null").groupBy(key).agg(F.avg("g").alias("grade"))
    named = F.lower(F.regexp_extract(F.col(lang).cast("string"), r"^\s*([A-Za-z]{2})(?![A-Za-z])", 1))
    by_tongue = docs.select(named.alias("t"), F.col(key)).where("t <> ''").join(grades, key, "left").groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count("grade").alias("graded"))
    known_tongues = sorted(by_tongue.collect(), key=lambda r: (r["graded"] < 2 * ENOUGH, -r["n"], r["t"]))  # two letters: 676 rows at most
    tongues = [r["t"] for i, r in enumerate(known_tongues) if r["graded"] >= 2 * ENOUGH or i < TONGUES]
    number = F.coalesce(*[F.when(F.col("_lang") == t, F.lit(i)) for i, t in enumerate(tongues)], F.lit(None).cast("int"))
    # the edges are written once and never moved again
    graph = edges(docs.withColumn("_lang", named), key, text, "_lang").join(grades, key, "left").withColumn("tongue", number).drop("_lang")
    graph = scratch.cut(graph.withColumn("fold", F.when(F.col("grade").isNotNull(), F.pmod(F.xxhash64(F.col(key)), F.lit(2)).cast("int"))))
    words, known, mean, spread = propagate(graph, key, tongues, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((words, known, mean, spread))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, mean, spread = shared.value
        for batch in batches:
            nodes, share, row, value, reach = _values(batch, words, known, mean)
            n = batch.num_rows
            votes = np.stack([np.bincount(row, share * s[nodes], n) for s in spread]) if len(spread) else np.zeros((1, n))
            keep = [batch.column(c) for c in (key, "letters", "n", "grade", "fold")]
            yield pa.RecordBatch.from_arrays(
                [*keep, *(pa.array(v.astype(np.float64)) for v in value), pa.array(reach.astype(np.float64)), pa.array(votes.argmax(0).astype(np.int32))],
                names=[key, "letters", "n", "grade", "fold", "v0", "v1", "v2", "reach", "tongue"],
            )

    kind = graph.schema[key].dataType.simpleString()
    scored = scratch.cut(graph.mapInArrow(score, f"`{key}` {kind}, letters double, n bigint, grade double, fold int, v0 double, v1 double, v2 double, reach double, tongue int"))
    scratch.drop(graph)
    prose = (F.col("n") >= LEAST_WORDS) & (F.col("letters") >= LEAST_LETTERS) & (F.col("reach") >= 0.5)
    # values of every language and channel are brought to one mean and spread over all running prose
    stats = scored.where(prose).groupBy("tongue").agg(*[f(f"v{c}").alias(f"{n}{c}") for c in range(CHANNELS) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).collect()
    scale = {r["tongue"]: [(r[f"m{c}"], max(r[f"s{c}"] or 0.0, 1e-9)) for c in range(CHANNELS)] for r in stats}

    def level_of(c: int):
        of = lambda k, other: F.coalesce(*[F.when(F.col("tongue") == t, F.lit(x[c][k])) for t, x in scale.items()], F.lit(other))
        return (F.col(f"v{c}") - of(0, 0.0)) / of(1, 1.0)

    z = level_of(0)
    held = scored.where("grade is not null").select("tongue", F.when(F.col("fold") == 0, level_of(2)).otherwise(level_of(1)).alias("z"), "grade", F.xxhash64(F.col(key)).alias("h")).orderBy("h").limit(fit_rows).collect()
    crowds: dict[int | None, dict[int, int]] = {}
    for r in scored.where(prose).select("tongue", F.floor(F.least(F.greatest(z, F.lit(-7.0)), F.lit(7.0)) * STEPS).alias("at")).groupBy("tongue", "at").count().collect():  # a fixed number of steps a language
        for t in (r["tongue"], None):
            crowds.setdefault(t, {})[r["at"]] = crowds.get(t, {}).get(r["at"], 0) + r["count"]
    level = F.lit(bands[0])
    for i in range(1, len(bands)):
        rows = [(r["tongue"], r["z"], r["grade"] >= i - 0.5) for r in held]
        general, own = _cut([(v, y) for _, v, y in rows], crowds.get(None, {})), {}
        for t in scale:
            mine = [(v, y) for k, v, y in rows if k == t]
            if min(sum(y for _, y in mine), sum(not y for _, y in mine)) >= ENOUGH:
                own[t] = _cut(mine, crowds.get(t, {}))
        cut = F.coalesce(*[F.when(F.col("tongue") == t, F.lit(c)) for t, c in own.items()], F.lit(general))
        level = F.when(z >= cut, F.lit(bands[i])).otherwise(level)
    # a graded document keeps its grade; between two bands that its readers named the graph decides
    rank = F.coalesce(*[F.when(F.col("_level") == b, F.lit(float(i))) for i, b in enumerate(bands)])
    fixed = F.greatest(F.floor("grade"), F.least(F.ceil("grade"), rank))
    out = scored.withColumn("_level", level)
    named_level = F.coalesce(*[F.when(fixed == i, F.lit(b)) for i, b in enumerate(bands)], F.col("_level"))
    return out.select(key, F.coalesce("grade", "v0").alias("difficulty"), named_level.alias("level"), prose.alias("prose"))
