"""Candidate pairs of records of one entity, from stems in metric space and places (problems 2 and 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.groups import components
from kindred.llm.metric import prefixes, radius_join
from kindred.llm.names import STEM, city_key, features, generic_words, same_name, state_code
from kindred.scratch import Scratch

#: Evidence of place and time: what agreement and conflict are worth. Years are off by a little, states are now and then wrong.
CITY, CITY_OFF, STATE, STATE_OFF, YEAR, YEAR_OFF = 3.0, -4.0, 1.0, -1.0, 1.5, -1.0
YEARS = 4
#: What counts for two rows without any place or year whose names agree in nearly all words.
BARE = 1.5
#: A name that lacks more than one word of the other is no ground to join two groups.
SURE = 0.85


def profiles(df: DataFrame, table: str, key: str, name: str) -> DataFrame:
    """(tab, id, name, city, st, year) of rows with a key and a name."""
    year = F.expr("try_cast(year as int)")
    return df.select(F.lit(table).alias("tab"), F.col(key).cast("string").alias("id"), F.col(name).cast("string").alias("name"), city_key(F.col("city")).alias("city"), state_code(F.col("state")).alias("st"), year.alias("year")).where(
        "id is not null and name is not null"
    )


def prepare(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows with the profile p of each, profiles): a profile is a distinct reading of name, city, state and year in one table.
    Rows whose names have no own words are left out."""
    rows = scratch.cut(rows)
    known = features(rows.select("name"), scratch.cut(generic_words(rows, "name", "city")), scratch)
    nc = F.concat_ws(";", F.concat_ws(" ", "stems"), F.concat_ws(" ", F.array_sort("others")))
    place = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("city", "st", "year")]
    rows = scratch.cut(rows.join(known, "name").withColumn("nc", nc).withColumn("p", F.concat_ws("|", "tab", "nc", *place)))
    first = lambda c: F.min(c).alias(c)
    profs = scratch.cut(rows.groupBy("p").agg(first("tab"), first("nc"), first("stems"), first("others"), first("city"), first("st"), first("year"), F.count(F.lit(1)).alias("copies")))
    return rows.select("tab", "id", "p"), profs


def evidence(x: str, y: str):
    """(score, strong): what places and years say for and against; strong when a city agrees."""
    c = lambda s, n: F.col(f"{s}{n}")
    near = F.levenshtein(c(x, "city"), c(y, "city"), 2)
    same = (c(x, "city") == c(y, "city")) | (near >= 0)
    cut = F.when(F.least(F.length(c(x, "city")), F.length(c(y, "city"))) >= 4, c(x, "city").startswith(c(y, "city")) | c(y, "city").startswith(c(x, "city"))).otherwise(False)
    city = F.when(c(x, "city").isNull() | c(y, "city").isNull(), 0.0).when(same | cut, CITY).otherwise(CITY_OFF)
    st = F.when(c(x, "st").isNull() | c(y, "st").isNull(), 0.0).when(c(x, "st") == c(y, "st"), STATE).otherwise(STATE_OFF)
    year = F.when(c(x, "year").isNull() | c(y, "year").isNull(), 0.0).when(F.abs(c(x, "year") - c(y, "year")) <= YEARS, YEAR).otherwise(YEAR_OFF)
    return city + st + year, city == CITY


def near_stems(profs: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of the stems that may stand for each other, as same_stem() has it: within the radius, or one cut off."""
    stems = scratch.cut(profs.select(F.explode("stems").alias("stem")).distinct())
    return scratch.cut(radius_join(stems.where(F.length("stem") >= STEM), "stem", scratch=scratch).unionByName(prefixes(stems, "stem", 4)).distinct())


def near_cities(profs: DataFrame, scratch: Scratch) -> DataFrame:
    """(city, towns): the keys of all cities that evidence() takes for this one, itself included."""
    cities = scratch.cut(profs.select("city").where("city is not null").distinct())
    same = cities.select(F.col("city").alias("a"), F.col("city").alias("b"))
    near = radius_join(cities, "city", 0, scratch).unionByName(prefixes(cities, "city", 4)).unionByName(same)
    return scratch.cut(near.groupBy(F.col("b").alias("city")).agg(F.collect_set(F.concat(F.lit("c"), F.col("a"))).alias("towns")))


def candidates(profs: DataFrame, scratch: Scratch, across: tuple[str, str] | None = None, near: DataFrame | None = None, towns: DataFrame | None = None) -> DataFrame:
    """(pa, pb, name_sim, score, strong) of profile pairs whose names do not contradict each other and whose places speak for them.

    Pairs meet on a stem within the radius and one thing of place or time, so a stem used everywhere never pairs with itself as
    a whole; rows that have neither place nor year meet by their names alone. Two cities must agree, so rows with cities meet on near cities alone; where a city is missing, rows meet on the
    state, a near year or an equal name: that is every pair that evidence() lets pass. With ``across`` = (left table, right
    table) pairs run from the one to the other, else within each table.
    """
    near = near if near is not None else near_stems(profs, scratch)
    towns = towns if towns is not None else near_cities(profs, scratch)
    cols = ["p", "tab", "nc", "city", "st", "year"]

    def loose(mark: str, years: int) -> Column:
        """The keys of state, year and name; mark tells whose city is missing."""
        year = F.when(F.col("year").isNotNull(), F.transform(F.sequence(F.col("year") - years, F.col("year") + years), lambda y: F.concat(F.lit(f"y{mark}"), y.cast("string"))))
        rest = F.array(F.when(F.col("st").isNotNull(), F.concat(F.lit(f"s{mark}"), F.col("st"))), F.concat(F.lit(f"n{mark}"), F.col("nc")))
        return F.concat(F.array_compact(rest), F.coalesce(year, F.array().cast("array<string>")))

    gone, none = F.col("city").isNull(), F.array().cast("array<string>")
    bare = gone & F.col("st").isNull() & F.col("year").isNull()
    # a row without city meets all rows on the keys marked 0; a row with one meets rows without on those marked 1, which within a
    # table would only give the same pairs in the other order
    # rows without any place or year meet each other on the stem alone: there is one such profile a name
    left = F.when(bare, F.array(F.lit("z"), F.concat(F.lit("n0"), F.col("nc")))).when(gone, loose("0", 0)).otherwise(F.concat(F.array(F.concat(F.lit("c"), F.col("city"))), loose("1", 0) if across else none))
    right = F.concat(F.coalesce("towns", none), loose("0", YEARS), F.when(gone, loose("1", YEARS)).otherwise(none) if across else none, F.when(bare, F.array(F.lit("z"))).otherwise(none))
    side = lambda df, x, what: df.select(*[F.col(c).alias(f"{x}_{c}") for c in cols], F.explode("stems").alias("stem"), what.alias("what")).select(*[f"{x}_{c}" for c in cols], "stem", F.explode("what").alias("key"))
    a, b = side(profs, "a", left), side(profs.join(towns, "city", "left"), "b", right)
    if across:
        a, b = a.where(F.col("a_tab") == across[0]), b.where(F.col("b_tab") == across[1])
    score, strong = evidence("a_", "b_")
    nothing = lambda x: F.coalesce(F.col(f"{x}city"), F.col(f"{x}st"), F.col(f"{x}year").cast("string")).isNull()
    bare = nothing("a_") & nothing("b_")
    sides = F.lit(True) if across else F.col("a_tab") == F.col("b_tab")
    pair = ["a_p", "b_p", "a_nc", "b_nc", "score", "strong", "bare"]
    # the exploded sides are larger than size estimates say: never broadcast them
    b = b.hint("merge")
    same = a.join(b, ["stem", "key"])
    other = a.withColumnRenamed("stem", "a").hint("merge").join(near, "a").withColumnRenamed("b", "stem").drop("a").join(b, ["stem", "key"])
    met = same.unionByName(other.select(same.columns)).where(sides & (F.lit(True) if across else F.col("a_p") != F.col("b_p"))).withColumn("score", score).withColumn("strong", strong).withColumn("bare", bare).where("score >= -1 and (score >= 1 or a_nc = b_nc or bare)")
    if not across:  # keys marked 0 are given to one side only, so such a pair may come in one order
        first = F.col("a_p") < F.col("b_p")
        met = met.select(*[F.when(first, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a_p", "b_p"), ("b_p", "a_p"), ("a_nc", "b_nc"), ("b_nc", "a_nc"))], "score", "strong", "bare")
    met = scratch.cut(met.select(*pair).distinct())

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = lambda nc: [x.split() for x in nc.split(";", 1)]
        for b in batches:
            sims = [1.0 if x == y else same_name(*split(x), *split(y)) for x, y in zip(b["a_nc"], b["b_nc"])]
            out = b.assign(name_sim=sims)
            yield out[out["name_sim"] > 0]

    names = met.select("a_nc", "b_nc").distinct().mapInPandas(judge, "a_nc string, b_nc string, name_sim double")
    met = met.join(names, ["a_nc", "b_nc"]).where(f"not bare or name_sim >= {SURE}")
    # where neither side has any place or year, the whole name is all the evidence there can be
    return scratch.cut(met.select(F.col("a_p").alias("pa"), F.col("b_p").alias("pb"), "name_sim", F.when(F.col("bare"), F.lit(BARE)).otherwise(F.col("score")).alias("score"), "strong"))


def entities(profs: DataFrame, cand: DataFrame, scratch: Scratch) -> DataFrame:
    """(p, entity) of every profile.

    Profiles that agree in place and nearly all words form the groups. The others, with a word or a place missing, join the one
    group that speaks for them most; if two groups do so equally, they join none, so a bare surname never ties a family
    together. What is left joins among itself.
    """
    sure = cand.where(F.col("strong") & (F.col("name_sim") >= SURE))
    roots = scratch.cut(components(sure, "pa", "pb", scratch).withColumnRenamed("node", "p").withColumnRenamed("root", "entity"))
    weight = (F.col("score") + 2 * F.col("name_sim")).alias("w")
    loose = cand.where(~(F.col("strong") & (F.col("name_sim") >= SURE)))
    ways = loose.select(F.col("pa").alias("p"), F.col("pb").alias("o"), weight).unionByName(loose.select(F.col("pb").alias("p"), F.col("pa").alias("o"), weight))
    free = ways.join(roots, "p", "left_anti")
    options = free.join(roots.withColumnRenamed("p", "o"), "o").groupBy("p", "entity").agg(F.max("w").alias("w"))
    best = options.groupBy("p").agg(F.max("w").alias("best"))
    joined = scratch.cut(options.join(best, "p").where("w >= best - 0.01").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("entity")).where("n = 1").select("p", "entity"))
    placed = roots.unionByName(joined)
    rest = loose.where("score >= 1").select("pa", "pb").join(placed.select(F.col("p").alias("pa")), "pa", "left_anti").join(placed.select(F.col("p").alias("pb")), "pb", "left_anti")
    among = components(rest, "pa", "pb", scratch).withColumnRenamed("node", "p").withColumnRenamed("root", "entity")
    return profs.select("p").join(placed.unionByName(among), "p", "left").select("p", F.coalesce("entity", "p").alias("entity"))


def same_entity(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(tab, id, entity) of the rows of profiles(); rows that name nobody are left out. A written table: variants() reads it several times."""
    keyed, profs = prepare(rows, scratch)
    return scratch.cut(keyed.join(entities(profs, candidates(profs, scratch), scratch), "p").select("tab", "id", "entity"))


def variants(groups: DataFrame) -> DataFrame:
    """(id_a, id_b): every pair of rows of one table and entity, the smaller id first."""
    g = groups.select("tab", "entity", "id").distinct()
    many = g.groupBy("tab", "entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tab", "entity")
    g = g.join(many, ["tab", "entity"])
    return g.withColumnRenamed("id", "id_a").join(g.withColumnRenamed("id", "id_b"), ["tab", "entity"]).where("id_a < id_b").select("id_a", "id_b")
