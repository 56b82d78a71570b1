"""One form for text that looks the same (problem 6).

Each token's characters name the scripts they may belong to, counting look-alikes: Cyrillic а may stand for Latin a. The scripts
of a token are intersected. An empty intersection of the characters' own scripts marks a mixed-script token; a token of one
foreign script in which every character has a Latin look-alike is a whole-script confusable. Both are spelled in the script
that all their characters can take: Latin where every foreign character looks Latin, else the foreign script, with Latin
characters turned into its look-alikes. The decision depends on nothing but the look, so look-alike tokens get one spelling.
Before that, width and compatibility forms, joined letters, accents, invisible characters, special spaces and hyphens are
brought to one form.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from kindred.scratch import Scratch

# Characters of other scripts that look like an ASCII letter, by the letter, in the order of the alphabet.
CYRILLIC = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜһасеіјорѕухԁѵԛԝӏɡҽ",
        "ABESIJKMHOPCTYXYGQWhaceijopsyxdvqwlge",
    )
)
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳορνιαυϲγκ", "ABEZHIKMNOPTYXCjopviaucyk"))
ARMENIAN = dict(zip("ՕՍօոսցհյզ", "OUonughjq"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"))
COPTIC = dict(zip("ⲤⲎⲒⲔⲘⲚⲞⲢⲦⲨⲬⲟⲣⲥ", "CHIKMNOPTYXopc"))
# Letters and signs of Latin itself that look like an ASCII letter or sign.
OTHER = dict(zip("ıȷⅼꞌԀɑɡɩƖꓸ", "ijl'dagil."))
SPACES = "               　"
HYPHENS = "‐‑‒–—―−﹘﹣－⁃"
INVISIBLE_EXTRA = "͏ᅟᅠ឴឵ㅤﾠ"  # letters and marks without ink

SCRIPTS = {"Cyrl": CYRILLIC, "Grek": GREEK, "Armn": ARMENIAN, "Cher": CHEROKEE, "Lisu": LISU, "Copt": COPTIC}
LATIN_OF = {k: v for table in SCRIPTS.values() for k, v in table.items()}
_HOME = {k: script for script, table in SCRIPTS.items() for k in table}
FOREIGN_OF = {s: {v: k for k, v in reversed(list(table.items()))} for s, table in SCRIPTS.items()}
_PLAIN = str.maketrans({**dict.fromkeys(SPACES, " "), **dict.fromkeys(HYPHENS, "-"), **OTHER})


@lru_cache(100_000)
def _script(ch: str) -> str | None:
    """The script of a letter, None for what belongs to all scripts."""
    if ch in _HOME:
        return _HOME[ch]
    if ch.isascii():
        return "Latn" if ch.isalpha() else None
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "")
    for word, code in (("LATIN", "Latn"), ("CYRILLIC", "Cyrl"), ("GREEK", "Grek"), ("ARMENIAN", "Armn"), ("CHEROKEE", "Cher"), ("LISU", "Lisu"), ("COPTIC", "Copt")):
        if name.startswith(word):
            return code
    return name.split(" ")[0] or None


@lru_cache(100_000)
def _possible(ch: str) -> frozenset[str] | None:
    """The scripts whose letters look like this character, None for what fits all."""
    base = unicodedata.normalize("NFD", ch)[0]
    home = _script(base)
    if home is None:
        return None
    found = {home}
    if base in LATIN_OF:
        found.add("Latn")
        base = LATIN_OF[base]
    if home == "Latn" or "Latn" in found:
        found.update(s for s, table in FOREIGN_OF.items() if base in table)
    return frozenset(found)


def resolved(token: str) -> tuple[frozenset[str] | None, frozenset[str]]:
    """(scripts the whole token can be spelled in, scripts it is spelled in). The first is None for a token without letters."""
    can: frozenset[str] | None = None
    own = set()
    for ch in token:
        p = _possible(ch)
        if p is not None:
            can = p if can is None else can & p
            own.add(_script(unicodedata.normalize("NFD", ch)[0]))
    return can, frozenset(own)


@lru_cache(200_000)
def _spell(token: str) -> str:
    if token.isascii():
        return token
    can, own = resolved(token)
    if not can or own == {"Latn"}:
        return token
    script = "Latn" if "Latn" in can else min(can)
    out = []
    for ch in unicodedata.normalize("NFD", token):
        latin = LATIN_OF.get(ch, ch)
        out.append(latin if script == "Latn" else FOREIGN_OF.get(script, {}).get(latin, ch))
    return "".join(out)


def visible(text: str | None) -> str | None:
    """The one form of a text; texts that look the same have the same form. Null stays null; letter case, accents, ASCII
    punctuation and ASCII white space stay as they are."""
    if text is None or text.isascii() and text.isprintable():
        return text
    # a lone accent keeps its place: NFKC would give it a space of its own
    text = unicodedata.normalize("NFKC", text.translate(_PLAIN)).translate(_PLAIN)
    text = "".join(
        ch for ch in text if not (unicodedata.category(ch) in ("Cf", "Cc") and ch not in "\t\n\x0b\x0c\r" or ch in INVISIBLE_EXTRA or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef")
    )
    if text.isascii():
        return text
    out, token = [], []
    for ch in unicodedata.normalize("NFC", text):
        if ch.isalpha() or unicodedata.category(ch)[0] == "M":
            token.append(ch)
        else:
            out.append(_spell("".join(token)))
            token = []
            out.append(ch)
    out.append(_spell("".join(token)))
    return unicodedata.normalize("NFC", "".join(out))


def _visible(s: pd.Series) -> pd.Series:
    return s.map(visible, na_action="ignore")


def visible_form(name: Column) -> Column:
    return pandas_udf(_visible, StringType())(name)


def same_look(df: DataFrame, key: str, name: str) -> DataFrame:
    """(id_a, id_b): the pairs of rows whose names differ as stored but show the same visible text; the smaller id comes first.

    Work is done on distinct spellings: only forms with two or more spellings meet the rows again, so equal names are never
    paired. Null names, names that show nothing and null keys are no case; repeated rows give no repeated pair; an empty table
    gives an empty result.
    """
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(name).cast("string").alias("raw")).where("id is not null and raw is not null").distinct()
    scratch = Scratch(df.sparkSession, "look")
    # written once: the form is made once for each spelling
    spellings = scratch.cut(rows.select("raw").distinct().withColumn("form", visible_form(F.col("raw"))))
    several = spellings.where(F.trim("form") != "").groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    kept = scratch.cut(spellings.join(several, "form"))
    rows = scratch.cut(rows.join(kept, "raw"))
    # every pair of spellings, then the rows of both sides; the larger side of a pair of spellings is never repeated for itself
    pairs = kept.alias("x").join(kept.alias("y"), "form").where("x.raw < y.raw").select(F.col("x.raw").alias("ra"), F.col("y.raw").alias("rb"))
    a, b = rows.select(F.col("raw").alias("ra"), F.col("id").alias("ia")), rows.select(F.col("raw").alias("rb"), F.col("id").alias("ib"))
    met = pairs.join(a, "ra").join(b, "rb").where("ia <> ib")
    return met.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
