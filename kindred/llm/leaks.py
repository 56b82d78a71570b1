"""Evaluation texts in a corpus by spaced seeds (problem 8).

A seed is a short run of word positions of which a fixed mask ignores some, so a replaced word at an ignored position leaves the
seed intact. The seeds of all test items form a table of hashes; every corpus text, whole, is turned into the same hashes at
every position and joined with that table. Around each hit the item is laid over the text and compared word by word: stretches
with most words in place are kept, their length in words of the item is added up, and the item counts as leaked when its
stretches, however many, together reach COVER of its words.

Words shared by many different item texts are turns of phrase. A seed of such words only is no seed, and within the stretches the
rare words must agree too, so two items of one pattern with other names are not taken for each other. An item whose
words are mostly common has its common seeds too, and the verification decides. Equal texts are one item until the
end, when the pairs found are given to all their keys.

The corpus is read once for every block of items and never shuffled; a block's seed table has a fixed bound (BLOCK_WORDS), so the
join runs beside the scan; more items make more blocks, and no item or text is left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.scratch import Scratch

# Fixed masks: word positions that count, of runs of three to six words.
MASKS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 3, 4), (0, 2, 4))
COVER = 0.4
#: Share of a stretch's word weight that must be in place, where a word weighs the logarithm of how few items have it.
AGREE = 0.6
#: A stretch ends where more than this many words in a row differ.
GAP = 2
SHORTEST = 3
BLOCK_WORDS = 2_000_000
#: A character of a script written without spaces is a word by itself.
UNSPACED = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\u0e00-\u0e7f"
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.casefold()) if text else []


def form(text: str) -> str:
    """The words of a text alone; those that only punctuation parts are joined by a hyphen. The form has the words of its text."""
    return " ".join("-".join(p) for x in text.casefold().split() if (p := WORD.findall(x)))


class Items:
    """The seed table of a block of items."""

    def __init__(self, rows: list[tuple], common: dict[str, int], total: int):
        self.keys = [k for k, _ in rows]
        texts = [t for _, t in rows]
        self.words = [words(t) for t in texts]
        # a word joined by punctuation, as LAD-2222, counts once
        self.share = [np.array([1 / len(p) for x in t.casefold().split() if (p := WORD.findall(x)) for _ in p]) for t in texts]
        df = Counter(w for ws in set(map(tuple, self.words)) for w in set(ws))
        df.update({w: n - df[w] for w, n in common.items() if w in df})
        self.vocab = {w: i + 1 for i, w in enumerate(sorted(df))}
        weight = np.zeros(len(self.vocab) + 1)
        for w, i in self.vocab.items():
            weight[i] = math.log((total + 1) / df[w]) / math.log(total + 1) if total > 1 else 1.0
        self.weight = np.maximum(weight, 0.01)
        often = max(3, total * 0.02)
        self.rare = np.zeros(len(self.vocab) + 1, bool)
        for w, i in self.vocab.items():
            self.rare[i] = df[w] <= often
        self.ids = [np.array([self.vocab[w] for w in ws], np.int64) for ws in self.words]
        self.size = np.array([s.sum() for s in self.share])
        # the words of items that have common seeds too
        plain = [self.plain(n) for n in range(len(self.ids))]
        self.asked = np.zeros(len(self.vocab) + 1, bool)
        for ids, p in zip(self.ids, plain):
            if p:
                self.asked[ids] = True
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, ids in enumerate(self.ids):
            for m in range(len(MASKS)):
                at, h = self.hashes(ids, m)
                for a, x in zip(at.tolist(), h.tolist()):
                    if plain[n] or any(self.rare[ids[a + o]] for o in MASKS[m]):
                        seeds[x].append((n, a))
            if 0 < len(ids) < SHORTEST:  # an item of one or two words is found as a whole
                seeds[int(ids[0]) | 1 << 62].append((n, 0))
        self.seeds = dict(seeds)
        self.sorted = np.array(sorted(seeds), np.uint64)
        self.short = {int(ids[0]) for ids in self.ids if 0 < len(ids) < SHORTEST}

    def plain(self, n: int) -> bool:
        """Whether item n would still agree as a whole if all its rare words were others: rare seeds alone are too few for it."""
        weight, rare = self.weight[self.ids[n]], self.rare[self.ids[n]]
        return float(weight[~rare].sum()) >= AGREE * float(weight.sum())

    def hashes(self, ids: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all seeds of one mask in a sequence of word numbers; 0 is a word of no item."""
        mask = MASKS[m]
        n = len(ids) - mask[-1]
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        cols = [ids[o : o + n] for o in mask]
        good = (cols[0] > 0) & (cols[1] > 0) & (cols[2] > 0)
        good &= self.rare[cols[0]] | self.rare[cols[1]] | self.rare[cols[2]] | (self.asked[cols[0]] & self.asked[cols[1]] & self.asked[cols[2]])
        at = np.flatnonzero(good)
        h = np.full(len(at), m + 1, np.uint64)
        for c, k in zip(cols, MULT):
            h = (h ^ c[at].astype(np.uint64)) * k
            h ^= h >> np.uint64(29)
        return at, h & np.uint64((1 << 62) - 1)

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, 0) for w in words(text)], np.int64)

    def leaked(self, n: int, doc: np.ndarray, hits: list[tuple[int, int]]) -> bool:
        """Whether the text holds enough of item n; hits are (position in the text, position in the item)."""
        ids = self.ids[n]
        size = len(ids)
        pieces = []
        for shift in {d - i for d, i in hits}:
            lo, hi = max(0, -shift), min(size, len(doc) - shift)
            same = np.flatnonzero(ids[lo:hi] == doc[lo + shift : hi + shift]) + lo
            if not len(same):
                continue
            for run in np.split(same, np.flatnonzero(np.diff(same) > GAP + 1) + 1):
                a, b = int(run[0]), int(run[-1]) + 1
                if len(run) < min(SHORTEST, size):
                    continue
                full, got = self.weight[ids[a:b]].sum(), self.weight[ids[run]].sum()
                if got >= AGREE * full and len(run) >= 0.5 * (b - a):
                    pieces.append((float(self.share[n][a:b].sum()), a, b, a + shift))
        # the longest pieces that keep the item's order and do not overlap
        pieces.sort(reverse=True)
        kept: list[tuple[int, int, int]] = []
        covered = np.zeros(size, bool)
        for _, a, b, d in pieces:
            if all((a < x) == (d < z) for x, y, z in kept) and covered[a:b].sum() < 0.5 * (b - a):
                kept.append((a, b, d))
                covered[a:b] = True
        return float(self.share[n][covered].sum()) >= COVER * self.size[n] - 1e-9


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item_key) of every document that holds an item, or stretches with COVER of its words or more, in order.

    Null, blank and wordless items and texts are no case; equal items are found together; a repeated document gives one row.
    Null keys are left out. Case, punctuation, layout and single replaced words do not matter. Empty tables give no rows.
    """
    spark = docs.sparkSession
    src = items.select(F.col(item_key), F.col(item_text).cast("string").alias("_t")).where(F.col(item_key).isNotNull() & F.col("_t").rlike(r"(?U)\w")).dropDuplicates([item_key])

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([form(t) for t in b.column(1).to_pylist()], pa.string())], names=[item_key, "_t"])

    scratch = Scratch(spark, "leaks")
    src = scratch.cut(src.mapInArrow(forms, f"`{item_key}` {src.schema[item_key].dataType.simpleString()}, _t string").where("_t <> ''"))
    # equal texts are searched once, under the smallest of their keys
    texts = src.groupBy("_t").agg(F.min(item_key).alias("_first"))
    alone, texts = F.split("_t", "[- ]"), scratch.cut(texts.select("_first", "_t"))
    size = texts.agg(F.countDistinct(F.translate("_t", "-", " ")), F.sum(F.size(alone))).first()
    total, blocks = size[0], max(1, -(-(size[1] or 0) // BLOCK_WORDS))
    base = docs.select(F.col(key), F.col(text).cast("string").alias("_t")).where(F.col(key).isNotNull() & F.col("_t").isNotNull())
    kinds = f"`{key}` {base.schema[key].dataType.simpleString()}, `{item_key}` {src.schema[item_key].dataType.simpleString()}"
    block = F.pmod(F.xxhash64(F.translate("_t", "-", " ")), F.lit(blocks))
    if blocks > 1:  # in how many texts of all blocks a word is, by the block that has the word
        each = texts.select(F.translate("_t", "-", " ").alias("_t")).distinct().select(block.alias("_b"), F.explode(F.array_distinct(alone)).alias("w"))
        often = each.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        counts = scratch.cut(each.distinct().join(often, "w"))
    parts = []
    for b in range(blocks):
        mine = texts if blocks == 1 else texts.where(block == b)
        common = {} if blocks == 1 else {r["w"]: r["n"] for r in counts.where(F.col("_b") == b).toLocalIterator()}
        shared = spark.sparkContext.broadcast(Items([(r[0], r[1]) for r in mine.collect()], common, total))
        out = pa.schema([(key, _arrow(base.schema[key])), (item_key, _arrow(src.schema[item_key]))])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, out=out) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                keys, found_k, found_i = batch.column(0).to_pylist(), [], []
                for start in range(0, len(keys), 256):
                    docs = [table.numbers(t) for t in batch.column(1).slice(start, 256).to_pylist()]
                    flat = np.concatenate([x for d in docs for x in (d, np.zeros(8, np.int64))]) if docs else np.empty(0, np.int64)
                    begin = np.cumsum([0, *(len(d) + 8 for d in docs)])
                    hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                    rounds = [table.hashes(flat, m) for m in range(len(MASKS))]
                    if table.short:
                        at = np.flatnonzero(np.isin(flat, list(table.short)))
                        rounds.append((at, flat[at].astype(np.uint64) | np.uint64(1 << 62)))
                    for at, h in rounds:
                        if not len(table.sorted):
                            continue
                        pos = np.minimum(np.searchsorted(table.sorted, h), len(table.sorted) - 1)
                        ok = table.sorted[pos] == h
                        for a, x in zip(at[ok].tolist(), h[ok].tolist()):
                            d = int(np.searchsorted(begin, a, "right")) - 1
                            for n, i in table.seeds[x]:
                                hits[d, n].append((a - int(begin[d]), i))
                    for (d, n), where in hits.items():
                        if table.leaked(n, docs[d], where):
                            found_k.append(keys[start + d])
                            found_i.append(table.keys[n])
                yield pa.RecordBatch.from_arrays([pa.array(found_k, out.field(0).type), pa.array(found_i, out.field(1).type)], schema=out)

        # a block's pairs are written before its table goes, so one table at a time is in memory
        parts.append(scratch.cut(base.mapInArrow(run, kinds).distinct()))
        shared.destroy()
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    keys = src.join(texts, "_t").select(F.col("_first"), item_key)
    return res.withColumnRenamed(item_key, "_first").join(keys, "_first").select(key, item_key)


def _arrow(field) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)
