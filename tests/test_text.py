import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions.text import _fold, _jaro_winkler, acronym_keys, guard_formula, key_text, normalize, record_text, strptime_pattern, text_grams, word_grams


def one(spark, value, fn, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"c {kind}").select(fn).collect()]


def test_normalize(spark):
    got = one(spark, ["  Société Générale & Co., S.A. ", None, "", "!!!", "a_b\tc", "Straße ﬁ"], normalize("c"))
    assert got == ["societe generale and co s a", "", "", "", "a b c", "strasse fi"]


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127), max_size=30))
def test_ascii_rule_is_the_general_rule(text):
    import re

    assert _fold(text) == " ".join(re.sub("[^a-z0-9]+", " ", text.lower().replace("&", " and ")).split())


def test_key_text_folds_whole_numbers(spark):
    df = spark.createDataFrame([(1985.0, "1985.0", 1985), (None, "02139", 2139), (1.5, " ", -5)], "d double, s string, i int")
    rows = df.select(key_text(df, "d"), key_text(df, "s"), key_text(df, "i")).collect()
    assert [tuple(r) for r in rows] == [("1985", "1985", "1985"), ("", "02139", "2139"), ("1 5", "", "5")]


def test_record_text_and_acronyms(spark):
    df = spark.createDataFrame([("International Business Machines", None), ("IBM", "NY")], "a string, b string")
    assert [r[0] for r in df.select(record_text(["a", "b"])).collect()] == ["international business machines", "ibm ny"]
    a, x = acronym_keys(F.col("n"))
    rows = df.select(normalize("a").alias("n")).select(a, x).collect()
    assert [tuple(r) for r in rows] == [(None, "ibm"), ("ibm", None)]


def test_grams(spark):
    assert one(spark, ["ab"], word_grams(F.col("c"), 2, 4)) == [[" a", "ab", "b ", " ab", "ab ", " ab "]]
    assert one(spark, ["a", ""], word_grams(F.col("c"), 9, 10)) == [[" a "], []]
    assert one(spark, ["abcd", "a"], text_grams(F.col("c"), 2, 3)) == [["ab", "bc", "cd", "abc", "bcd"], []]


def test_jaro_winkler_known_values():
    for a, b, v in (("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("", "", 1.0), ("a", "", 0.0), ("завод", "завод", 1.0)):
        assert _jaro_winkler(a, b) == pytest.approx(v, abs=1e-6)


def test_formula_guard(spark):
    assert one(spark, ["=1+1", " @x", "a=b", None], guard_formula(F.col("c"))) == ["'=1+1", "' @x", "a=b", None]


def test_strptime():
    assert strptime_pattern("%d/%m/%Y %H:%M") == "dd/MM/yyyy HH:mm"
    with pytest.raises(ValueError):
        strptime_pattern("%Q")


def test_fold_series_keeps_missing():
    from kindred.functions.text import _fold_series

    assert _fold_series(pd.Series(["É", None])).tolist() == ["e", None]
