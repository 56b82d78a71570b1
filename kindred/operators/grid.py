"""Exact nearest neighbours over a grid of blocks, with nothing through the driver.

Queries and items are rows of one form. Items lie in blocks of at most BLOCK rows; a cell of the grid meets one block of items with
one part of the queries. A cell's rows are sent to one task, items first: the task builds an index of the block, then the queries
stream past it. Queries are repeated once a block of items, items once a part of the queries, and there are only as many parts as
tasks are needed. With groups a cell holds whole groups, so queries never meet items of other groups; a group too large for one
cell gets a grid of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kindred.functions.text import jaro_winkler_codes, padded_codes

#: Items of one block.
BLOCK = 50_000
#: Float sums depend on their order: similarities are rounded to this many places before ranking.
PLACES = 12
SLACK = 1e-9


def spread(queries: DataFrame, items: DataFrame, groups: list[str], order: list[str], block: int) -> tuple[DataFrame, int]:
    """(rows of all cells with _part, _cell and _side, number of parts). Both sides have the same columns; ``order`` sorts a cell's items."""
    spark, g = queries.sparkSession, list(groups)
    both = queries.withColumn("_side", F.lit(1)).unionByName(items.withColumn("_side", F.lit(0)))
    q, n = F.count(F.when(F.col("_side") == 1, 1)), F.count(F.when(F.col("_side") == 0, 1))
    width = max(1, spark.sparkContext.defaultParallelism)
    total = both.agg(q.alias("q"), n.alias("n")).first()
    span = max(500, -(-total["q"] // width))
    tall = lambda c: F.greatest(F.lit(1), F.ceil(c / F.lit(block))).cast("int")
    if g:
        sizes = both.groupBy(*g).agg(q.alias("q"), n.alias("n")).where((F.col("q") > span) | (F.col("n") > block)).withColumn("_r", tall(F.col("n")))
        sizes = sizes.withColumn("_l", F.greatest(F.lit(1), F.ceil(F.col("q") / (F.lit(span) * F.col("_r")))).cast("int")).select(*g, "_l", "_r")
        more = sizes.agg(F.coalesce(F.sum(F.col("_l").cast("long") * F.col("_r")), F.lit(0))).first()[0]
        buckets = max(2 * width, -(-total["n"] // block))
        parts = buckets + more
        both = both.join(sizes, g, "left")
    else:
        rows = max(1, -(-total["n"] // block))
        parts = rows * max(1, -(-total["q"] // (span * rows)))
        both = both.withColumn("_r", F.lit(rows)).withColumn("_l", F.lit(parts // rows))
    own, mine = F.pmod(F.xxhash64(*order), F.coalesce("_r", F.lit(1))).cast("int"), F.pmod(F.xxhash64(*order), F.coalesce("_l", F.lit(1))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1)
    both = both.withColumn("_row", F.explode(F.when(F.col("_side") == 1, upto("_r")).otherwise(F.array(own)))).withColumn("_col", F.explode(F.when(F.col("_side") == 0, upto("_l")).otherwise(F.array(mine))))
    if g:
        bucket = F.pmod(F.xxhash64(*g), F.lit(buckets)).cast("long")
        cell = F.when(F.col("_l").isNull(), bucket).otherwise(F.xxhash64(*g, "_row", "_col"))
        part = F.when(F.col("_l").isNull(), bucket).otherwise(F.lit(buckets) + F.pmod(cell, F.lit(max(more, 1))))
    else:
        cell = F.col("_row").cast("long") * F.col("_l") + F.col("_col")
        part = cell
    out = both.withColumn("_cell", cell).withColumn("_part", part.cast("int")).select("_part", "_cell", "_side", *queries.columns)
    return out.repartitionById(parts, F.col("_part")).sortWithinPartitions("_cell", "_side", *order), parts


def over_cells(queries: DataFrame, items: DataFrame, groups: list[str], order: list[str], index: Callable[[list[pa.RecordBatch]], object], schema: StructType, block: int = BLOCK) -> DataFrame:
    """What ``index(items of a block).search(batch of queries)`` returns over all cells of the grid, as rows of ``schema``."""
    rows, _ = spread(queries, items, groups, order, block)
    empty = to_arrow_schema(schema).empty_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, made = None, [], None
        yield from empty.to_batches()
        for b in batches:
            cells, sides = b.column(1).to_numpy(), b.column(2).to_numpy()
            turns = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for lo, hi in zip([0, *turns], [*turns, len(cells)]):
                if lo == hi:
                    continue
                if cells[lo] != cell:
                    cell, held, made = cells[lo], [], None
                if sides[lo] == 0:
                    held.append(b.slice(lo, hi - lo))
                elif held:
                    made = made or index(held)
                    yield made.search(b.slice(lo, hi - lo))

    return rows.mapInArrow(run, schema)


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the place where each row's begin, with the end."""
    at = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), at - at[0]


def joined(batches: list[pa.RecordBatch], name: str) -> pa.Array:
    one = pa.chunked_array([b.column(name) for b in batches]).combine_chunks()
    return one if isinstance(one, pa.Array) else one.chunk(0)


def best(rows: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest, ties by the smaller row."""
    if len(rows) > k:
        edge = np.partition(sims, len(sims) - k)[len(sims) - k]
        rows, sims = rows[sims >= edge], sims[sims >= edge]
    order = np.lexsort((rows, -sims))[:k]
    return rows[order], sims[order]


class GramIndex:
    """An inverted index of sparse unit vectors, searched rare grams first.

    A query adds up its grams' postings from the shortest on. What the grams not yet read can add to any item is bounded by the norm
    of their weights and by the largest weight each has in an item. As soon as that bound is below the k-th best similarity already
    proven, no new item can come up, the long postings are never read, and the few items still in reach are computed in full.
    """

    def __init__(self, batches: list[pa.RecordBatch], k: int, least: float, groups: list[str], names: list[str]):
        self.k, self.least, self.groups, self.names = k, least, groups, names
        self.texts = joined(batches, "text")
        hashes, self.begin = flat(joined(batches, "h"))
        self.w = flat(joined(batches, "w"))[0]
        self.lens = np.diff(self.begin)
        order = np.argsort(hashes, kind="stable")
        self.known, start = np.unique(hashes[order], return_index=True)
        self.start = np.append(start, len(hashes))
        self.count = np.diff(self.start)
        self.owner, self.posted = np.repeat(np.arange(len(self.texts)), self.lens)[order], self.w[order]
        self.top = np.maximum.reduceat(self.posted, start) if len(start) else np.empty(0)
        self.gram = np.empty(len(hashes), np.int64)
        self.gram[order] = np.repeat(np.arange(len(self.known)), self.count)
        self.total, self.seen, self.dense = np.zeros(len(self.texts)), np.zeros(len(self.texts), bool), np.zeros(len(self.known))

    def whole(self, rows: np.ndarray) -> np.ndarray:
        """Dot products of items with the query in ``dense``."""
        lens = self.lens[rows]
        ends = np.cumsum(lens)
        at = np.repeat(self.begin[rows] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(np.repeat(np.arange(len(rows)), lens), self.dense[self.gram[at]] * self.w[at], len(rows))

    def one(self, v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.count[v], kind="stable")
        v, x = v[order], x[order]
        sizes = self.count[v]
        rest = np.minimum(np.sqrt(np.cumsum((x * x)[::-1])), np.cumsum((x * self.top[v])[::-1]))[::-1]
        rest = np.append(rest, 0.0)  # rest[j]: the most that grams from j on add
        bar, j, read = max(self.least, 10.0**-PLACES) - SLACK, 0, 0
        self.dense[v] = x
        work = 8 * self.k
        while j < len(v) and rest[j] >= bar:
            read += sizes[j]
            s, e = self.start[v[j]], self.start[v[j] + 1]
            who = self.owner[s:e]
            self.total[who] += x[j] * self.posted[s:e]
            self.seen[who] = True
            j += 1
            if read >= work and j < len(v):
                work = 4 * read
                met = np.flatnonzero(self.seen)
                if len(met) >= self.k:
                    sums = self.total[met]
                    top = met[np.argpartition(sums, len(met) - self.k)[len(met) - self.k :]]
                    bar = max(bar, self.whole(top).min() - SLACK)
        met = np.flatnonzero(self.seen)
        rows = met[self.total[met] + rest[j] >= bar]
        if sizes[j:].sum() > 8 * self.lens[rows].sum():
            sims = self.whole(rows)
        else:  # the postings left are shorter than the items in reach
            for x_, i in zip(x[j:], v[j:]):
                s, e = self.start[i], self.start[i + 1]
                who = self.owner[s:e]
                self.total[who] += x_ * self.posted[s:e]
                self.seen[who] = True
            sims = self.total[rows]
            met = np.flatnonzero(self.seen)
        self.total[met] = 0
        self.seen[met] = False
        self.dense[v] = 0
        sims = np.round(sims, PLACES)
        ok = (sims >= self.least) & (sims > 0)
        return best(rows[ok], sims[ok], self.k)

    def search(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        (h, begin), (w, _) = flat(batch.column("h")), flat(batch.column("w"))
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        hit = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        who, rows, sims = [], [], []
        for i, (lo, hi) in enumerate(zip(begin, begin[1:])):
            ok = hit[lo:hi]
            if ok.any():
                r, s = self.one(at[lo:hi][ok], w[lo:hi][ok])
                who.append(np.full(len(r), i))
                rows.append(r)
                sims.append(s)
        gather = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.empty(0, kind)
        who = pa.array(gather(who, np.int64))
        return pa.RecordBatch.from_arrays([batch.column("text").take(who), *(batch.column(g).take(who) for g in self.groups), self.texts.take(pa.array(gather(rows, np.int64))), pa.array(gather(sims, float))], names=self.names)


class VectorIndex:
    """Dense unit vectors, met by matrix products within each group."""

    def __init__(self, batches: list[pa.RecordBatch], k: int, least: float, names: list[str]):
        self.k, self.least, self.names = k, least, names
        self.ids, gk = joined(batches, "id"), joined(batches, "gk").to_numpy(zero_copy_only=False)
        values = flat(joined(batches, "v"))[0]
        self.matrix = values.reshape(len(gk), -1)
        self.members: dict[str, np.ndarray] = {}
        names_, inverse = np.unique(gk.astype(str), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        for name, rows in zip(names_, np.split(order, np.cumsum(np.bincount(inverse))[:-1])):
            self.members[name] = rows

    def search(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        gk = batch.column("gk").to_numpy(zero_copy_only=False).astype(str)
        mine = flat(batch.column("v"))[0].reshape(len(gk), -1)
        who, rows, sims = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for name in np.unique(gk):
            held = self.members.get(name)
            if held is None:
                continue
            asked, items = np.flatnonzero(gk == name), self.matrix[held]
            for at in range(0, len(asked), 256):
                part = asked[at : at + 256]
                near = np.round(np.clip(mine[part] @ items.T, -1, 1), PLACES)
                for i, s in zip(part, near):
                    ok = np.flatnonzero(s >= self.least)
                    r, s = best(held[ok], s[ok], self.k)
                    who.append(np.full(len(r), i))
                    rows.append(r)
                    sims.append(s)
        take = lambda column, xs: column.take(pa.array(np.concatenate(xs).astype(np.int64)))
        return pa.RecordBatch.from_arrays([take(batch.column("id"), who), take(self.ids, rows), pa.array(np.concatenate(sims))], names=self.names)


class WinklerIndex:
    """Texts searched for the one of largest Jaro-Winkler similarity, likeliest first.

    No similarity exceeds what the letters in common (counted in KINDS bins, which never counts fewer) and the common start allow, so a
    query computes its items in the order of that bound and stops where the bound falls below the best one found."""

    KINDS, STEP = 64, 48

    def __init__(self, batches: list[pa.RecordBatch], names: list[str]):
        self.names = names
        texts = joined(batches, "text").to_pylist()
        self.first = joined(batches, "first")
        self.codes, self.lens = padded_codes(texts)
        self.bags = self._bags(self.codes, self.lens)
        self.members: dict[str, np.ndarray] = {}
        for i, c in enumerate(joined(batches, "c").to_pylist()):
            self.members.setdefault(c, []).append(i)
        self.members = {c: np.array(rows) for c, rows in self.members.items()}

    def _bags(self, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        n, width = codes.shape
        row = np.repeat(np.arange(n), lens)
        kind = codes[np.arange(width) < lens[:, None]] % self.KINDS
        return np.bincount(row * self.KINDS + kind, minlength=n * self.KINDS).reshape(n, self.KINDS).astype(np.int16)

    def search(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, kinds = batch.column("text").to_pylist(), batch.column("c").to_pylist()
        codes, lens = padded_codes(texts)
        bags = self._bags(codes, lens)
        who, rows, sims = [], [], []
        for i, c in enumerate(kinds):
            held = self.members.get(c)
            if held is None:
                continue
            m = np.minimum(self.bags[held], bags[i]).sum(1)
            most = np.where(m > 0, (m / lens[i] + m / self.lens[held] + 1) / 3, 0)
            start = min(4, codes.shape[1], self.codes.shape[1])
            same = np.cumprod((self.codes[held, :start] == codes[i, :start]) & (np.arange(start) < np.minimum(lens[i], self.lens[held])[:, None]), 1).sum(1)
            most = np.where(most > 0.7, most + same * 0.1 * (1 - most), most)
            order = np.argsort(-most, kind="stable")
            top, at = (-1.0, 0), 0
            while at < len(order) and most[order[at]] >= top[0] - SLACK:
                some = held[order[at : at + self.STEP]]
                s = np.round(jaro_winkler_codes(np.repeat(codes[i : i + 1], len(some), 0), np.repeat(lens[i], len(some)), self.codes[some], self.lens[some]), PLACES)
                for x, r in zip(s.tolist(), some.tolist()):
                    if x > top[0] or x == top[0] and r < top[1]:
                        top = (x, r)
                at += self.STEP
            who.append(i)
            rows.append(top[1])
            sims.append(top[0])
        return pa.RecordBatch.from_arrays([batch.column("text").take(pa.array(who, pa.int64())), self.first.take(pa.array(rows, pa.int64())), pa.array(sims, pa.float64())], names=self.names)
