import base64
import random

import pytest

from kindred.llm.leaks import Items, leaks
from kindred.llm.look import resolved, same_look, visible
from kindred.llm.reading import reading_levels
from kindred.llm.tokens import Encoder, Prefixes, encode

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n  x", "don't we'll I'VE", "ﬁ ｗｉｄｅ é é ​﻿", "<|endoftext|> <pad>", "a" * 3000, "½ ² 12345 ①", "\x1c\x1d a\x85b\xa0c　d", "जोड़े मिलाना 企業名", "🏭🔗 ✓✗→≥", "x" + " " * 500, "\r\n\t\x0b\x0c", "\ud800"[:0]]


def test_ids_equal_the_library(library):
    e = Encoder(PATH)
    rng = random.Random(1)
    texts = ODD + ["".join(chr(rng.choice([32, 39, 10, rng.randrange(33, 127), rng.randrange(160, 600), rng.randrange(0x400, 0x500), rng.randrange(0x2000, 0x2070)])) for _ in range(rng.randrange(60))) for _ in range(800)]
    for t in texts:
        assert e.ids(t).tolist() == library.encode_ordinary(t), repr(t)


def test_every_token_encodes_to_itself():
    p = Encoder(PATH).pieces.pairs
    assert all(p.merge(t) == [t] for t in list(p.rank)[::37])


def test_appends_and_edits_are_exact():
    pairs, rng = Encoder(PATH).pieces.pairs, random.Random(3)
    for _ in range(40):
        data = bytes(rng.choice(b"abcdeinrst hello") for _ in range(rng.randrange(1, 80)))
        t = Prefixes(pairs, data[:10])
        t.append(data[10:])
        assert t.ids() == Prefixes(pairs, data).ids() == tuple(pairs.rank[x] for x in pairs.merge(data))
        at, n, new = rng.randrange(len(data)), rng.randrange(4), bytes(rng.choice(b"xyz") for _ in range(3))
        t.replace(at, n, new)
        assert t.ids() == Prefixes(pairs, data[:at] + new + data[at + n :]).ids()


def test_encode_rows(spark, library):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "x"), (4, "word " * 20000)]
    got = encode(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", PATH).collect()
    assert sorted(((r.doc_id or 0), tuple(r.ids)) for r in got) == sorted(((i or 0), tuple(library.encode_ordinary(t or ""))) for i, t in rows)


def test_visible():
    same = ["Acme Corp", "Аcmе Соrp", "Ａｃｍｅ Ｃｏｒｐ", "Ac​me Co­rp", "A﻿cme Corp"]
    assert {visible(x) for x in same} == {"Acme Corp"}
    assert visible("Éa ﬁ") == visible("Éa fi") and visible("a‑b") == visible("a-b")
    differ = ["Acme Corp", "acme Corp", "Acme  Corp", "Acmé Corp", "Acme, Corp", "AcmeCorp"]
    assert len({visible(x) for x in differ}) == len(differ)
    # a foreign word stays foreign, and Latin letters inside it join it
    assert visible("Завод Тоол") == "Завод Тоол" == visible("Зaвoд Тooл") and visible(None) is None and visible("") == ""
    assert resolved("Тоол")[0] == {"Cyrl"} and "Latn" in resolved("Сор")[0]


def test_scripts_that_look_latin():
    assert visible("ᎪᏴᏟ") == visible("ꓮꓐꓚ") == "ABC" and visible("ⲤⲞ") == "CO" and visible("ɑɡɩ") == "agi"


def test_same_look(spark):
    rows = [("1", "Acme", 0), ("2", "Аcme", 0), ("3", "Acme", 0), ("4", "Ａcme", 0), ("5", None, 0), ("6", "​", 0), ("7", "", 0), ("8", "acme", 0), (None, "Аcme", 0), ("2", "Аcme", 0)]
    df = spark.createDataFrame(rows, "k string, n string, id_a int")
    assert sorted(map(tuple, same_look(df, "k", "n").collect())) == [("1", "2"), ("1", "4"), ("2", "3"), ("2", "4"), ("3", "4")]
    assert same_look(df.limit(0), "k", "n").count() == 0


ITEM = "In 1912 the firm Lorelock opened a depot in Drumasund while Dranesund an importer of sash chains opened a yard. Its 5307 workers left hall 1403."
SISTER = ITEM.replace("Lorelock", "Mirewyn").replace("Drumasund", "Tolagarth").replace("Dranesund", "Busequist").replace("1912", "1840").replace("5307", "77").replace("1403", "9")


def test_leaks(spark):
    filler = [(10 + i, ITEM.replace("Lorelock", f"N{i}").replace("Drumasund", f"P{i}").replace("Dranesund", f"Q{i}").replace("1912", str(2000 + i)).replace("5307", str(i)).replace("1403", str(500 + i))) for i in range(30)]
    items = spark.createDataFrame([(1, ITEM), (2, SISTER), (3, None), (4, "  "), (5, "!!"), (6, "Zorblax"), *filler], "item_id long, text string")
    w = ITEM.split()
    docs = [
        (1, "Before. " + ITEM.upper().replace(" ", "\n") + " After."),
        (2, "noise " + " ".join("word" if i % 9 == 4 else x for i, x in enumerate(w)) + " noise"),
        (3, "noise " + " ".join(w[8:19]) + " noise"),
        (4, "noise " + " ".join(w[4:8])),
        (5, None), (6, ""), (7, " ".join(w[3:9]) + " and then much later something else " + " ".join(w[17:23])),
        (8, "the works of Zorblax stand"), (None, ITEM), (1, ITEM), (9, "long " * 50000 + ITEM),
    ]
    got = {tuple(r) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", items, "item_id", "text").collect()}
    assert {x for x in got if x[1] in (1, 2, 6)} == {(1, 1), (2, 1), (3, 1), (7, 1), (8, 6), (9, 1)}
    assert leaks(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_leak_blocks_give_the_same(spark, monkeypatch):
    import kindred.llm.leaks as L

    items = spark.createDataFrame([(i, f"{ITEM} number{i} alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i} theta{i} iota{i} kappa{i} lam{i} mu{i} nu{i} xi{i} om{i} pi{i} rho{i} sig{i} tau{i} ups{i} phi{i} chi{i} psi{i}") for i in range(12)], "item_id long, text string")
    docs = items.selectExpr("item_id * 10 as doc_id", "text")
    one = {tuple(r) for r in leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    monkeypatch.setattr(L, "BLOCK_WORDS", 120)
    assert {tuple(r) for r in leaks(docs, "doc_id", "text", items, "item_id", "text").collect()} == one >= {(i * 10, i) for i in range(12)}


def test_leaks_of_repeated_and_common_texts(spark):
    rng = random.Random(4)
    other = [(100 + i, " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(20))) for i in range(200)]
    plain = [(400 + i, " ".join(rng.sample("one two three four five six seven eight nine ten".split(), 10))) for i in range(30)]
    items = spark.createDataFrame([(i, ITEM if i % 2 else ITEM.upper() + "!") for i in range(90)] + other + plain, "item_id long, text string")
    docs = [(1, f"Before. {ITEM} After."), (2, other[3][1]), (3, "so " + plain[5][1]), (4, "none of it")]
    got = {tuple(r) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", items, "item_id", "text").collect()}
    assert {x for x in got if x[0] != 3} == {(1, i) for i in range(90)} | {(2, 103)} and (3, 405) in got


def test_leak_in_many_stretches(spark):
    rng = random.Random(8)
    ws = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(60)]
    broken = " ".join(" ".join(ws[i : i + 4]) + " | line 1 of page 7 |" for i in range(0, 60, 4))
    d, i = spark.createDataFrame([(1, broken)], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(ws)), (2, "other words here")], "item_id long, text string")
    assert [tuple(r) for r in leaks(d, "doc_id", "text", i, "item_id", "text").collect()] == [(1, 1)]


def test_leak_blocks_count_words_of_every_script(spark, monkeypatch):
    import kindred.llm.leaks as L

    made = []
    init = Items.__init__
    monkeypatch.setattr(Items, "__init__", lambda self, rows, common, total: made.append((common, total)) or init(self, rows, common, total))
    items = spark.createDataFrame([(i, f"für été straße wort{i} zahl{i}") for i in range(12)], "item_id long, text string")
    monkeypatch.setattr(L, "BLOCK_WORDS", 20)
    docs = items.selectExpr("item_id as doc_id", "text")
    assert leaks(docs, "doc_id", "text", items, "item_id", "text").count() >= 12
    assert len(made) > 1 and all(total == 12 and all(n == 12 for w, n in c.items() if w in ("für", "été", "strasse")) and (not c or "été" in c) for c, total in made)


def test_leaks_in_every_script_and_any_blocks(spark, monkeypatch):
    import kindred.llm.leaks as L

    rng = random.Random(6)
    rows = []
    for low, high, gap, n in ((97, 122, " ", 7), (0x430, 0x44F, " ", 7), (0x4E00, 0x4FFF, "", 1)):
        shared = gap.join("".join(chr(rng.randrange(low, high)) for _ in range(n)) for _ in range(8))
        rows += [shared + gap + gap.join("".join(chr(rng.randrange(low, high)) for _ in range(n)) for _ in range(14)) for _ in range(16)] + [shared]
    rows += ["what is the name of the city where he was born"] * 4
    items = spark.createDataFrame(list(enumerate(rows)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before, {t}. after") for i, t in enumerate(rows)], "doc_id long, text string")
    found = lambda: {tuple(r) for r in leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    one = found()
    assert {(i, i) for i in range(len(rows))} <= one
    assert {(len(rows) - 1, len(rows) - k) for k in (1, 2, 3, 4)} <= one
    monkeypatch.setattr(L, "BLOCK_WORDS", 40)
    assert found() == one


def test_seed_masks_survive_a_replaced_word():
    t = Items([(1, ITEM)], {}, 1)
    ids = t.ids[0].copy()
    ids[5] = 0
    assert any(len(t.hashes(ids[2:9], m)[0]) for m in range(6))


def test_reading_levels(spark):
    rng = random.Random(2)
    pools = {b: [f"{b}word{i}".replace("word", "wo" + "rd" * (k + 1)) for i in range(40)] for k, b in enumerate(("easy", "plain", "hard", "advanced"))}
    for b in pools:
        pools[b] = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in pools[b]]
    docs, labels = [], []
    for i in range(400):
        b = list(pools)[i % 4]
        docs.append((i, " ".join(rng.choice(pools[b] if rng.random() < 0.8 else pools[rng.choice(list(pools))]) for _ in range(50)), rng.choice(["en", "EN", None, "en-XX"])))
        if i % 3 == 0:
            labels.append((i, b if rng.random() < 0.95 else None, "r"))
    docs += [(900, None, "en"), (901, "", "en"), (902, "12 34 56 " * 40, None), (903, "{}[]();" * 90, "und"), (None, "easy", "en")]
    d, l = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, band string, reader string")
    args = ("doc_id", "band", ["easy", "plain", "hard", "advanced"])
    got = {r.doc_id: r for r in reading_levels(d, "doc_id", "text", "lang", l, *args).collect()}
    assert len(got) == 404
    right = sum(got[i].level == list(pools)[i % 4] for i in range(400) if i % 3)
    assert right > 0.9 * sum(1 for i in range(400) if i % 3)
    assert not any(got[i].prose for i in (900, 901, 902, 903))
    assert all(got[i].level == b and got[i].difficulty == list(pools).index(b) for i, b, _ in labels if b)
    assert {r.level for r in reading_levels(d, "doc_id", "text", "lang", l.limit(0), *args).collect()} == {"easy"}
    assert reading_levels(d.limit(0), "doc_id", "text", "lang", l, *args).count() == 0


def test_reading_levels_are_of_settled_words(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefghij"[i % 2 :: 2]) * rng.randrange(3, 6) for _ in range(30)), "en") for i in range(40)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i, ("easy", "hard")[i % 2], "r") for i in range(12)], "doc_id long, band string, reader string")
    args = (d, "doc_id", "text", "lang", l, "doc_id", "band", ["easy", "hard"])
    with pytest.raises(RuntimeError):
        reading_levels(*args, rounds=1).count()
    assert reading_levels(*args).count() == 40
