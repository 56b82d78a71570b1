"""Records as text lines: COL field VAL value, and labelled pairs of such records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELD = r"(?s)\bCOL\s+(\S+)\s+VAL\b\s*(.*?)\s*(?=\bCOL\s+\S+\s+VAL\b|$)"


def parse_fields(line: Column) -> Column:
    """The map of fields of a serialized record; a field without value is left out, the last of repeated fields wins."""
    names, values = F.regexp_extract_all(line, F.lit(_FIELD), F.lit(1)), F.regexp_extract_all(line, F.lit(_FIELD), F.lit(2))
    entries = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda e: e["v"] != "")
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def parse_json_record(line: Column) -> Column:
    """The map of fields of a record written as a JSON object, blanks left out; null when it is none."""
    m = F.from_json(line, "map<string,string>")
    return F.map_filter(m, lambda k, v: F.length(F.trim(v)) > 0)


def parse_record(line: Column) -> Column:
    return F.when(F.ltrim(line).startswith("{"), parse_json_record(line)).otherwise(parse_fields(line))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(left, right, label) of a file with two serialized records and a label on each line, separated by tabs."""
    cells = F.split("value", "\t")
    return spark.read.text(path).where(F.size(cells) >= 3).select(parse_fields(cells[0]).alias("left"), parse_fields(cells[1]).alias("right"), F.trim(cells[2]).cast("int").alias("label"))
