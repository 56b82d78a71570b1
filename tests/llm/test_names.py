import random

import pytest

from kindred.llm.entities import profiles, same_entity, variants
from kindred.llm.linkage import link, soft_logic
from kindred.llm.metric import prefixes, radius_join
from kindred.llm.names import Generics, city_key, distance, radius, same_name, state_code, tokens
from kindred.scratch import Scratch


def test_radius_join_finds_every_pair(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abdo") for _ in range(rng.randrange(3, 12))) for _ in range(220)}
    got = {(r.a, r.b) for r in radius_join(spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "s string"), "s").collect()}
    assert got == {(a, b) for a in words for b in words if a != b and distance(a, b, 2) <= radius(min(len(a), len(b)))}
    assert radius_join(spark.createDataFrame([], "s string"), "s").count() == 0
    p = prefixes(spark.createDataFrame([("druma",), ("drumavostil",), ("drum",)], "s string"), "s")
    assert {tuple(r) for r in p.collect()} == {("druma", "drumavostil"), ("drumavostil", "druma")}


def test_words():
    assert tokens("The G.K.B. - Gizasufas Corp. (DE) et al.") == ["gkb", "gizasufas"]
    assert tokens("POHUMIKE Theodore; B") == ["pohumike", "theodore", "b"] and tokens(None) == [] and tokens("F.P. Smith") == ["f", "p", "smith"]
    g = Generics(["foods", "battery", "northern", "valve"])
    assert g.parts("Didavofemfoods Inc") == (["didavofem"], ["foods"]) and g.parts("Battrey Foods") == ([], ["battery", "foods"])


@pytest.mark.parametrize("a,b,same", [
    ("rigodropax;group steel", "rigodropax;grp steel", True), ("rigodropax;steel", "rigodropax;marine", False), ("vizugladrur;vppg", "vizugladrur;general paper plastics", True),
    ("pohumike;b theodore", "pohumike;theo", True), ("pohumike;ray", "pohumike;raymond", True), ("pohumike;peggy", "pohumike;margaret", True), ("pohumike;john", "pohumike;mary", False),
    ("aaaaaaa bbbbbbb;steel", "aaaaaaa;steel", False), ("daehagon;chemical", "dazehagon;chem", True),
])
def test_names_agree(a, b, same):
    split = lambda x: [p.split() for p in x.split(";")]
    assert (same_name(*split(a), *split(b)) > 0) == same == (same_name(*split(b), *split(a)) > 0)


def test_places(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x,) for x in ("NY", "n.y.", "New York", "Alab.", "", None, "--", "unknown", "US")], "s string")
    assert [r[0] for r in df.select(state_code(F.col("s"))).collect()] == ["ny", "ny", "ny", "al", None, None, None, None, None]
    assert [r[0] for r in df.select(city_key(F.lit(" Nida-Stomouth.,"))).limit(1).collect()] == ["nidastomouth"]


def test_every_pair_the_evidence_accepts_is_proposed(spark):
    from pyspark.sql import functions as F

    from kindred.llm.entities import candidates, evidence

    rng = random.Random(7)
    cities = [None, None, "zsopoguton", "zopoguton", "lodroloford", "lodrololord", "lodro", "ohio", "ohxy"]
    places = [(rng.choice("lr"), rng.choice(cities), rng.choice([None, "ny", "ct"]), rng.choice([None, 1948, 1951, 2006])) for _ in range(60)]
    rows = [(f"{t}{i}", t, nc, nc.split(";")[0].split(), c, s, y) for i, (t, c, s, y) in enumerate(places) for nc in [rng.choice(["golabrevem;optics", "golabrevm;optics"])]]
    profs = spark.createDataFrame(rows, "p string, tab string, nc string, stems array<string>, city string, st string, year int")
    a, b = (profs.select(*[F.col(c).alias(f"{x}_{c}") for c in profs.columns]) for x in "ab")
    score, _ = evidence("a_", "b_")
    bare = " and ".join(f"{x}_{c} is null" for x in "ab" for c in ("city", "st", "year"))
    pairs = a.crossJoin(b).withColumn("s", score).where(f"s >= -1 and (s >= 1 or a_nc = b_nc or ({bare}))")
    for across, want in ((None, "a_tab = b_tab and a_p < b_p"), (("l", "r"), "a_tab = 'l' and b_tab = 'r'")):
        made = candidates(profs, Scratch(spark), across)
        got = [(r.pa, r.pb) for r in made.collect()]
        assert len(got) == len(set(got)) and set(got) == {(r.a_p, r.b_p) for r in pairs.where(want).collect()}


TRADES = ["Steel", "Marine", "Foods", "Battery", "Glass", "Paper"]
CITIES = [f"{x}{y}ville" for x in ("Alpha", "Bravo", "Delta", "Gamma", "Kappa") for y in ("mo", "ru", "ti")]


def firms():
    """60 background firms that make the trades generic, then cases."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        stem = "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4))
        rows.append((f"b{i:03}", f"{stem.title()} {TRADES[i % 6]} Inc", "AL", CITIES[i % 15], 1900 + i))
    return rows


def test_variants(spark):
    rows = firms() + [
        ("v1", "Zorabelix Steel Inc", "NY", "Alphamoville", 1950), ("v2", "STEEL INCORPORATED, ZORABELIX", None, "Alphamoville", 1951), ("v3", "Zorabelx Steel", "NY", None, 1950),
        ("w1", "Zorabelix Marine Corp", "NY", "Alphamoville", 1950), ("w2", "Zorabelix Steel Inc", "CA", "Kappativille", 1990), ("n1", None, "NY", "Alphamoville", 1950), ("n2", "Unknown", "NY", "Alphamoville", 1950),
        ("n3", "", None, None, None), ("v1", "Zorabelix Steel Inc", "NY", "Alphamoville", 1950), (None, "Zorabelix Steel Inc", "NY", "Alphamoville", 1950),
    ]
    df = spark.createDataFrame(rows, "k string, n string, state string, city string, year int")
    got = {tuple(r) for r in variants(same_entity(profiles(df, "t", "k", "n"), Scratch(spark))).collect()}
    assert {p for p in got if not p[0].startswith("b")} == {("v1", "v2"), ("v1", "v3"), ("v2", "v3")}
    assert variants(same_entity(profiles(df.limit(0), "t", "k", "n"), Scratch(spark))).count() == 0


def test_plans_of_variants_stay_small(spark):
    size = lambda df, what: df._jdf.queryExecution().optimizedPlan().toString().count(what)
    words = spark.createDataFrame([(f"gado{x}{y}lex",) for x in "bdfgklm" for y in "aeiou"], "s string")
    assert size(radius_join(words, "s"), "levenshtein(") == 2 and size(prefixes(words, "s"), "Join ") == 1  # each plan is held by the driver
    df = profiles(spark.createDataFrame(firms()[:20], "k string, n string, state string, city string, year int"), "t", "k", "n")
    assert size(variants(same_entity(df, Scratch(spark))), "Relation [") <= 4


def test_short_names(spark):
    names = {"f": ["Ford Co", "FORD COMPANY"], "i": ["IBM Corp", "I.B.M."], "m": ["3M", "3M Co"], "k": ["Kim Lee", "LEE, Kim"], "t": ["東芝", "東芝"], "z": ["Zora", "Zorabelix Inc"], "n": ["N/A", "NA"], "d": ["Dell Inc"], "b": ["Bell Inc"]}
    rows = firms() + [(f"{k}{j}", n, "NY", "Alphamoville", 1950) for k, ns in names.items() for j, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "k string, n string, state string, city string, year int")
    got = {tuple(r) for r in variants(same_entity(profiles(df, "t", "k", "n"), Scratch(spark))).collect()}
    assert {p for p in got if not p[0][1:].isdigit() or len(p[0]) == 2} == {(f"{k}0", f"{k}1") for k in "fimktz"}
    assert Generics(["kim", "lee"]).parts("Lee, Kim") == (["kimlee"], [])


def test_names_without_places(spark):
    rows = firms() + [("p1", "Zorabelix Steel Inc", None, None, None), ("p2", "Zorabelx Steel Inc", "--", "", None), ("p3", "Zorabelix Marine Inc", None, None, None), ("p4", "Zorabelix Steel", "NY", None, 1950)]
    schema = "k string, n string, state string, city string, year int"
    df = spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in variants(same_entity(profiles(df, "t", "k", "n"), Scratch(spark))).collect()}
    assert {p for p in got if p[0].startswith("p")} >= {("p1", "p2")} and not any("p3" in p for p in got)
    right = spark.createDataFrame([("R1", "ZORABELIX STEEL", None, None, None), ("R2", "Zorabelix Marine", "NY", None, None)], schema)
    both = profiles(spark.createDataFrame(rows[:61], schema), "l", "k", "n").unionByName(profiles(right, "r", "k", "n"))
    assert {(r.left_id, r.right_id) for r in link(both, "l", "r", Scratch(spark)).collect()} == {("p1", "R1")}


def wharves():
    """Six firms that make a trade generic, and one firm's spellings with it, misspelt, run together and without it."""
    rng = random.Random(9)
    stems = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(12)]
    rows = [(f"b{60 + i}", f"{stems[i].title()} Wharfage Inc", "AL", CITIES[i], 1900 + i) for i in range(6)]
    rows += [(f"b{70 + i}", f"{stems[6 + i].title()} Quarry Inc", "AL", CITIES[6 + i], 1900 + i) for i in range(6)]
    names = ["Zorabelix Wharfage Inc", "ZORABELIX INC", "Zorabelix Wharfag", "Zorabelixwharfage Corp", "Zorabelixquarrywharfage"]
    return rows + [(f"v{i}", n, "NY", "Alphamoville", 1950) for i, n in enumerate(names)] + [(f"w{i}", "Quarry Steel Inc", "NY", "Gammativille", 1950) for i in range(2)]


PADDING = 160_000  # rows that name nobody: more of them make a word of a few places rare


def padded(spark, df, table):
    return df.unionByName(spark.range(PADDING).selectExpr(f"'{table}' AS tab", "concat('x', id) AS id", "'N/A' AS name", "string(null) AS city", "string(null) AS st", "int(null) AS year"))


def test_a_trade_is_generic_however_large_the_table(spark):
    df = spark.createDataFrame(firms() + wharves(), "k string, n string, state string, city string, year int")
    rows = profiles(df, "t", "k", "n")
    found = lambda x: {p for p in map(tuple, variants(same_entity(x, Scratch(spark))).collect()) if p[0][0] in "vw"}
    want = {(f"v{i}", f"v{j}") for j in range(5) for i in range(j)}
    assert found(rows) == want  # the name of two generic words is nobody's here
    assert found(padded(spark, rows, "t")) == want | {("w0", "w1")}  # but not where one of them is rare


def test_a_rare_misspelling_of_a_trade_stands_for_others(spark):
    own = ["Gadupolex", "Tisorafim", "Lunepador", "Kefirosat", "Bomalunik", "Rosetupal"]
    rows = firms() + [(f"b{60 + i}", f"{x} Marne Inc", "AL", CITIES[i], 1900 + i) for i, x in enumerate(own)]  # a misspelt trade in six places
    rows += [(f"v{i}", n, "NY", "Alphamoville", 1950) for i, n in enumerate(["Zorabelix Marine Inc", "Zorabelix Marnie Inc", "Zorabelix Inc"])]
    df = profiles(spark.createDataFrame(rows, "k string, n string, state string, city string, year int"), "t", "k", "n")
    for table in (df, padded(spark, df, "t")):
        assert {p for p in map(tuple, variants(same_entity(table, Scratch(spark))).collect()) if p[0][0] == "v"} == {("v0", "v1"), ("v0", "v2"), ("v1", "v2")}


def test_a_trade_is_generic_for_links_too(spark):
    schema = "k string, n string, state string, city string, year int"
    left = profiles(spark.createDataFrame(firms() + wharves()[:13], schema), "l", "k", "n")
    right = profiles(spark.createDataFrame([(f"R{i}", n, "NY", "Alphamoville", 1950) for i, n in enumerate(["Zorabelix", "ZORABELIX WHARFAGE CORP", "Zorabelix Steel Corp"])], schema), "r", "k", "n")
    rows = padded(spark, left.unionByName(right), "l")
    assert {(r.left_id, r.right_id) for r in link(rows, "l", "r", Scratch(spark)).collect()} >= {("v0", "R0"), ("v0", "R1")}


def test_cut_off_generic_words_stay_whole():
    assert Generics(["verfahrenstechnik", "verfah", "steel"]).parts("Glabrizason Verfahrenste") == (["glabrizason", "verfahrenste"], [])
    assert Generics(["verfah", "steel"]).parts("Glabrizasonsteel") == (["glabrizason"], ["steel"])


def test_linkage(spark):
    left = firms() + [("L1", "Zorabelix Steel Inc", "NY", "Alphamoville", 1950), ("L2", "Vugaromin Glass Co", "CA", "Bravoruville", None), ("L3", None, "CA", "Bravoruville", 1900)]
    right = [(i.replace("b", "r"), n.upper().replace("INC", "INCORPORATED"), s, c, y) for i, n, s, c, y in firms()[:40]] + [("R1", "zorabelix steel", None, "Alphamoville", 1951), ("R2", "Zorabelix Marine", "NY", "Alphamoville", 1950), ("R3", "Vugaromin Glass", "TX", "Deltativille", 1999)]
    schema = "k string, n string, state string, city string, year int"
    rows = profiles(spark.createDataFrame(left, schema), "l", "k", "n").unionByName(profiles(spark.createDataFrame(right, schema), "r", "k", "n"))
    got = {(r.left_id, r.right_id): r.confidence for r in link(rows, "l", "r", Scratch(spark)).collect()}
    assert set(got) == {(f"b{i:03}", f"r{i:03}") for i in range(40)} | {("L1", "R1")}
    assert all(0.55 <= c <= 1 for c in got.values())
    assert link(rows.where("tab = 'l'"), "l", "r", Scratch(spark)).count() == 0


def test_soft_logic_is_the_convex_minimum(spark):
    from kindred.llm import linkage as L

    pairs = [("a", "x", 0.9, True), ("a", "y", 0.7, False), ("b", "y", 0.6, False), ("b", "z", 0.6, False), ("c", "w", 0.8, True)]
    df = spark.createDataFrame(pairs, "A string, B string, s double, strong boolean")
    got = {(r.A, r.B): r.confidence for r in soft_logic(df, Scratch(spark), rounds=60).collect()}

    def loss(y):
        t = sum(L.W_SIMILAR * max(0, s - y[a, b]) + L.W_PRIOR * y[a, b] for a, b, s, _ in pairs)
        for side in (0, 1):
            for k in {p[side] for p in pairs}:
                t += L.W_EXCLUSIVE * max(0, sum(y[p[:2]] for p in pairs if p[side] == k) - 1)
        return t

    best, rng = loss(got), random.Random(1)
    for _ in range(3000):
        trial = {k: min(1, max(0, v + rng.gauss(0, 0.1))) for k, v in got.items()}
        assert loss(trial) > best - 0.03
    assert got["c", "w"] == pytest.approx(0.8, abs=0.06) and got["a", "x"] > got["a", "y"]
    assert soft_logic(df.limit(0), Scratch(spark)).count() == 0


def test_every_component_iterates_until_it_has_settled(spark, monkeypatch):
    from kindred.llm import linkage as L

    rng = random.Random(3)
    groups = [[(f"a{n}.{i}", f"b{n}.{j}", rng.random(), rng.random() < 0.3) for i in range(rng.randrange(2, 5)) for j in range(rng.randrange(2, 7)) if rng.random() < 0.8] for n in range(12)]
    rows = spark.createDataFrame([p for g in groups for p in g], "A string, B string, s double, strong boolean")
    run = lambda **more: {(r.A, r.B): r.confidence for r in soft_logic(rows, Scratch(spark), **more).collect()}
    got = run()
    assert len(got) == sum(map(len, groups))
    monkeypatch.setattr(L, "SETTLED", 1e-6)
    longer = run()
    assert all(abs(got[k] - v) < 0.03 and (abs(v - L.ACCEPT) < 0.03 or (got[k] >= L.ACCEPT) == (v >= L.ACCEPT)) for k, v in longer.items())
    monkeypatch.setattr(L, "SETTLED", 0.05)
    quick = run()
    monkeypatch.setattr(L, "SMALL", 0)  # every component by tables
    assert run() == pytest.approx(quick, abs=1e-9)
    with pytest.raises(RuntimeError):
        run(rounds=1)
