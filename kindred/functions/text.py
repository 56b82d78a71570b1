"""Text as columns: normalized keys, n-grams, acronyms, and similarities."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Words that an acronym skips.
ACRONYM_STOP_WORDS = "and of the for inc corp co ltd llc plc company corporation incorporated limited".split()


def _fold(text: str) -> str:
    """Compatibility decomposition without marks, casefolded, `&` spelled out, every other sign a single space."""
    letters = (c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    spelled = "".join(letters).casefold().replace("&", " and ")
    # a sign is what is neither a word character nor an underscore's neighbour: str.isalnum covers letters and numbers
    return " ".join("".join(c if c.isalnum() else " " for c in spelled).split())


def _fold_series(s: pd.Series) -> pd.Series:
    return s.map(_fold, na_action="ignore")


def normalize(c: Column | str) -> Column:
    """Comparable text: no case, accents or punctuation, single spaces; empty for null. ASCII stays in the JVM."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    plain = c.rlike(r"^[\x00-\x7f]*$")
    ascii_form = F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    other = pandas_udf(_fold_series, T.StringType())(F.when(~plain, c))
    return F.when(c.isNull(), F.lit("")).when(plain, ascii_form).otherwise(other)


def clean(df: DataFrame, column: str) -> Column:
    """A value ready for a judge: null when missing, text trimmed (null when blank), whole floats below 1e15 as whole numbers."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):
        t = F.regexp_replace(c, r"^\s+|\s+$", "")
        return F.when(t != "", t)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(~F.isnan(c), F.when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string")))
    return c.cast("string")


def key_text(df: DataFrame, column: str) -> Column:
    """The normalized text of one key component: whole numbers agree however they are stored; empty when missing."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.StringType):
        return normalize(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^([+-]?[0-9]+)\.0+$", "$1"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c.cast("double")
        text = F.when(~F.isnan(c), F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")))
        return normalize(text)
    return normalize(c.cast("string"))


def record_text(columns: list[str]) -> Column:
    """One text of a record: its normalized fields joined by a space."""
    return F.trim(F.concat_ws(" ", *[normalize(c) for c in columns]))


def acronym_keys(c: Column, least: int = 2) -> tuple[Column, Column]:
    """(acronym, expansion) of normalized text: the text itself when it is one word of letters, and the initials of its words."""
    words = F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(ACRONYM_STOP_WORDS))
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    acronym = F.when(c.rlike(r"^\p{L}+$") & (F.length(c) >= least), c)
    return acronym, F.when(F.length(initials) >= least, initials)


def _cut_at(text: Column, n: int):
    # transform() passes an index to functions of two arguments, so n comes by closure
    return lambda i: text.substr(i, F.lit(n))


def word_grams(c: Column, low: int, high: int) -> Column:
    """Character n-grams inside words, each word padded by a space on both sides; a word shorter than ``low`` counts once whole."""

    def grams(w: Column) -> Column:
        w = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(w)
        parts = [F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), _cut_at(w, n))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
        return F.when(size < low, F.array(w)).otherwise(F.concat(*parts))

    return F.flatten(F.transform(F.filter(F.split(c, " "), lambda w: w != ""), grams))


def text_grams(c: Column, low: int, high: int) -> Column:
    """Character n-grams over the whole text. The text must be a plain column, as Spark takes no Python function inside a lambda."""
    size = F.length(c)
    parts = [F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), _cut_at(c, n))).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
    return F.concat(*parts)


def _bytes(a: str, b: str) -> tuple[bytes, bytes]:
    """Both texts with one byte a character, so that searching runs in C; rarer alphabets get numbers of their own."""
    try:
        return a.encode("latin-1"), b.encode("latin-1")
    except UnicodeEncodeError:
        code = {c: i for i, c in enumerate(dict.fromkeys(a + b), 1)}
        if len(code) > 255:
            return tuple(code[c].to_bytes(4, "big") for c in a), tuple(code[c].to_bytes(4, "big") for c in b)
        return bytes(code[c] for c in a), bytes(code[c] for c in b)


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = _bytes(a, b)
    reach = max(max(len(x), len(y)) // 2 - 1, 0)
    if isinstance(x, tuple):
        left, find = list(y), lambda c, lo, hi: next((j for j in range(lo, min(hi, len(y))) if left[j] == c), -1)
    else:
        left = bytearray(y)
        find = left.find
    used, mine = [], []
    for i, c in enumerate(x):
        j = find(c, i - reach if i > reach else 0, i + reach + 1)
        if j >= 0:
            left[j] = 0 if not isinstance(x, tuple) else None
            used.append(j)
            mine.append(c)
    if not mine:
        return 0.0
    used.sort()
    m, swaps = len(mine), sum(c != y[j] for c, j in zip(mine, used)) // 2
    jaro = (m / len(x) + m / len(y) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(x), len(y)) and x[prefix] == y[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def padded_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts as rows of one matrix, and the texts' lengths."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros((len(texts), max(1, int(lens.max(initial=1)))), np.int32)
    out[np.arange(out.shape[1]) < lens[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    return out, lens


def jaro_winkler_codes(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Jaro-Winkler of row pairs of two code matrices: one step a letter of x for all pairs at once."""
    n, at = len(x), np.arange(y.shape[1], dtype=np.int16)
    reach = np.maximum(np.maximum(nx, ny) // 2 - 1, 0).astype(np.int16)
    free = at < ny[:, None]
    met, rows = np.zeros(x.shape, bool), np.arange(n)
    low, high = -reach[:, None], reach[:, None]
    for i in range(int(nx.max(initial=0))):
        a, b = max(0, i - int(reach.max(initial=0))), min(len(at), i + int(reach.max(initial=0)) + 1)
        fits = free[:, a:b] & (y[:, a:b] == x[:, i : i + 1])
        off = at[a:b] - np.int16(i)
        fits &= off >= low
        fits &= off <= high
        if a >= b:
            break
        where = fits.argmax(1)
        hit = fits[rows, where] & (i < nx)
        free[rows[hit], a + where[hit]] = False
        met[:, i] = hit
    used = (at < ny[:, None]) & ~free
    m = met.sum(1)
    # the matched letters of both sides in order, side by side
    same = np.zeros((2, n, max(1, int(m.max(initial=0)))), np.int32)
    for k, (codes, mask) in enumerate(((x, met), (y, used))):
        row, col = np.nonzero(mask)
        same[k, row, (np.cumsum(mask, 1) - 1)[row, col]] = codes[row, col]
    swaps = (same[0] != same[1]).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / nx + m / ny + (m - swaps) / m) / 3, 0.0)
    k = min(4, x.shape[1], y.shape[1])
    start = np.cumprod((x[:, :k] == y[:, :k]) & (np.arange(k) < np.minimum(nx, ny)[:, None]), 1).sum(1)
    out = np.where(jaro > 0.7, jaro + start * 0.1 * (1 - jaro), jaro)
    equal = (nx == ny) & (x[:, : min(x.shape[1], y.shape[1])] == y[:, : min(x.shape[1], y.shape[1])]).all(1) if x.shape[1] == y.shape[1] else np.zeros(n, bool)
    return np.where(equal & (nx > 0), 1.0, out)


#: Pairs compared at once, and the length from which a text is compared by itself.
PAIRS, LONG = 4096, 200


def _jw_series(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.full(len(a), np.nan)
    rows = np.flatnonzero(a.notna().to_numpy() & b.notna().to_numpy())
    x, y = a.to_numpy()[rows].tolist(), b.to_numpy()[rows].tolist()
    size = np.maximum(np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, y), np.int64, len(y)))
    order = np.argsort(size, kind="stable")  # alike lengths waste no room
    few = int((size <= LONG).sum())
    for lo in range(0, few, PAIRS):
        part = order[lo : min(lo + PAIRS, few)]
        codes, lens = padded_codes([x[i] for i in part] + [y[i] for i in part])
        n = len(part)
        out[rows[part]] = jaro_winkler_codes(codes[:n], lens[:n], codes[n:], lens[n:])
    for i in order[few:]:
        out[rows[i]] = _jaro_winkler(x[i], y[i])
    out[rows[size == 0]] = 1.0
    return pd.Series(out)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity (prefix weight 0.1 above 0.7); null if either text is null. Batches are compared as matrices of codes."""
    return pandas_udf(_jw_series, T.DoubleType())(a, b)


def guard_formula(c: Column) -> Column:
    """Text safe to open in a spreadsheet: a leading sign that starts a formula gets an apostrophe."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]") | c.rlike(r"^[\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def strptime_pattern(fmt: str) -> str:
    """The Java date pattern of a strptime format; ValueError for a code without one."""
    # Format codes and their Java letters.
    codes = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "y": "yy", "b": "MMM", "B": "MMMM", "j": "DDD", "p": "a", "I": "hh", "z": "xx", "a": "EEE", "A": "EEEE", "%": "%"}
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            if fmt[i + 1 : i + 2] not in codes:
                raise ValueError(f"the date format code {fmt[i : i + 2]!r} is not supported")
            out.append(codes[fmt[i + 1]])
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)
