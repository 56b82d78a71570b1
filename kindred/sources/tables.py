"""Tables in files: delimited text, Parquet, Stata."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import guard_formula

SUFFIXES = (".csv", ".tsv", ".parquet", ".dta")


def _suffix(path: str) -> str:
    s = Path(str(path)).suffix.lower()
    if s not in SUFFIXES:
        raise ValueError(f"{path}: use one of {', '.join(SUFFIXES)}")
    return s


def read_table(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A table by its suffix. In delimited text every value is a string and only the empty cell is missing: NA, NULL and nan are values.
    Stata files are read on the driver, codes without their labels. Cells with line breaks need ``multiline``, which makes every file of
    delimited text one task; without it large files are split."""
    s = _suffix(path)
    if s == ".parquet":
        return spark.read.parquet(str(path))
    if s == ".dta":
        import pandas as pd

        frame = pd.read_stata(path, convert_categoricals=False)
        return spark.createDataFrame(frame.astype(object).where(frame.notna(), None)) if len(frame) else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in frame.columns))
    return spark.read.csv(str(path), header=True, inferSchema=False, sep="," if s == ".csv" else "\t", nullValue="", emptyValue="", quote='"', escape='"', lineSep="\n", multiLine=multiline, encoding="UTF-8")


def stata_value_labels(path: str, column: str) -> dict:
    """{code: label} of a column of a Stata file."""
    import pandas as pd

    with pd.read_stata(path, iterator=True) as reader:
        labels, names = reader.value_labels(), dict(zip(reader._varlist, reader._lbllist))
    return labels.get(names.get(column, column), {})


def write_table(df: DataFrame, path: str, single: bool = True, safe: bool = False) -> None:
    """Write a table by its suffix. Text and Stata results are small and go to one file through the driver's iterator; with
    ``single=False`` text becomes a folder of part files, as Parquet always does. ``safe`` guards cells against spreadsheet formulas."""
    s = _suffix(path)
    if len({c.lower() for c in df.columns}) != len(df.columns):
        raise ValueError("column names must be unique to be written")
    if safe:
        df = df.select(*[guard_formula(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    if s == ".parquet":
        df.write.mode("overwrite").parquet(str(path))
    elif s == ".dta":
        write_stata(df, path)
    elif single:
        import csv

        with open(path, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, delimiter="," if s == ".csv" else "\t", lineterminator="\n")
            out.writerow(df.columns)
            for row in df.toLocalIterator():
                out.writerow(["" if v is None else v for v in row])
    else:
        df.write.mode("overwrite").csv(str(path), header=True, sep="," if s == ".csv" else "\t", nullValue="", emptyValue="", quote='"', escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_stata(df: DataFrame, path: str) -> None:
    """A Stata file: names repaired to Stata's rules, booleans as bytes, whole numbers only up to 2**53."""
    import re

    frame = df.toPandas()
    names: dict[str, str] = {}
    for c in frame.columns:
        base = re.sub(r"\W", "_", c, flags=re.ASCII)
        base = (base if re.match(r"[A-Za-z_]", base) else "_" + base)[:32]
        name, k = base, 1
        while name in names.values():
            k += 1
            name = f"{base[: 31 - len(str(k))]}_{k}"
        names[c] = name
    for c in frame.columns:
        kind = frame[c].dtype.kind
        if kind in "iu" and len(frame) and frame[c].abs().max() > 2**53:
            raise ValueError(f"column {c!r} holds whole numbers beyond 2**53, which Stata cannot store; write it as text")
        if kind == "b":
            frame[c] = frame[c].astype("int8")
        elif kind in "iu":
            frame[c] = frame[c].astype("float64" if len(frame) and frame[c].abs().max() > 2_147_483_620 else "int32")
        elif kind == "O":
            frame[c] = frame[c].map(lambda v: "" if v is None or v != v else str(v))
    frame.rename(columns=names).to_stata(path, write_index=False, version=118)
