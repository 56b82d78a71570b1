"""Byte-level BPE ids of a whole corpus by prefix dynamic programming (problem 7).

For every byte prefix of a piece the encoder stores one number: the last token of that prefix's encoding. The token is unique,
because a sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours encode to themselves. So the
encoding of a prefix that ends in token t is the encoding of the prefix before t, followed by t, and

* the whole encoding is read backwards from the last prefix,
* appended bytes only add entries, and
* an edit keeps all entries before it.

The work is linear in the bytes, also for pieces of millions of bytes, where merging pairs by rank would be quadratic.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value of the public tokenizer: its rule for splitting text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same rule spelled out for texts of SAFE characters only, for the faster module re.
_L, _N, _S = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼-¾", r"\t\n\x0b\x0c\r \x85\xa0 -     　"
FAST = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
UNSAFE = r"[^\x00-\x1b\x20-ɏ - ‐-  €　�]"
#: A worker forgets its pieces beyond this number, so its memory stays bounded.
CACHE = 400_000


class BytePairs:
    """The vocabulary: bytes of every token with its rank, and the plain merge of short byte strings for checking two neighbours."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.longest = max(map(len, self.rank))
        self.suffixes: set[bytes] = {t[i:] for t in self.rank for i in range(len(t))}
        self._fits: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """BPE by its definition, for short strings: merge the neighbours of lowest rank until none can merge."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay as they are when their joined bytes are encoded."""
        key = (left, right)
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            found = self._fits[key] = self.merge(left + right) == [left, right]
        return found


class Prefixes:
    """The table of one piece: entry i is the length of the last token of the first i bytes."""

    def __init__(self, pairs: BytePairs, data: bytes = b""):
        self.pairs, self.data, self.last = pairs, b"", [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        data, last, rank, suffixes, fits = self.data, self.last, self.pairs.rank, self.pairs.suffixes, self.pairs.fits
        for end in range(len(last), len(data) + 1):
            found = 0
            for n in range(1, min(end, self.pairs.longest) + 1):
                token = data[end - n : end]
                if token not in suffixes:
                    break
                if token in rank:
                    start = end - n
                    if start == 0:
                        if n == 1 or self.pairs.merge(token) == [token]:
                            found = n
                            break
                    elif fits(data[start - last[start] : start], token):
                        found = n
                        break
            if not found:
                raise ValueError("the vocabulary lacks single bytes")
            last.append(found)

    def replace(self, at: int, length: int, new: bytes) -> None:
        """Exchange bytes; only entries after ``at`` are computed again."""
        rest = self.data[at + length :]
        self.data, self.last = self.data[:at], self.last[: at + 1]
        self.append(new + rest)

    def ids(self) -> tuple[int, ...]:
        out, end = [], len(self.data)
        while end:
            n = self.last[end]
            out.append(self.pairs.rank[self.data[end - n : end]])
            end -= n
        return tuple(reversed(out))


class _Pieces(dict):
    """Ids of pieces met so far."""

    def __init__(self, pairs: BytePairs):
        self.pairs = pairs

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        whole = self.pairs.rank.get(data)
        ids = (whole,) if whole is not None and (len(data) == 1 or self.pairs.merge(data) == [data]) else Prefixes(self.pairs, data).ids()
        if len(data) < 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        import re

        import regex

        self.pieces = _Pieces(BytePairs(path))
        self.unsafe, self.fast, self.full = re.compile(UNSAFE).search, re.compile(FAST).findall, regex.compile(PATTERN).findall

    def split(self, text: str) -> list[str]:
        return (self.full if self.unsafe(text) else self.fast)(text)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))), np.int32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, key: str, text: str, path: str, out: str = "ids") -> DataFrame:
    """(key, ids) of every row: the ids of its text, an empty list for a null or empty text. Rows stay as they are: repeated keys
    give repeated rows, a null key stays null; marker-like strings are plain text. Only the two columns are read, and nothing
    is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [enc.ids(x) for x in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, out])

    src = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = src.schema[key].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")
