import json

import pytest
from pyspark.sql import functions as F

from kindred import cli
from kindred.operators.judge import ColumnJudge, FatalError, HttpJudge, PandasJudge, judge, question
from kindred.operators.passes import exact, ngrams
from kindred.operators.review import create_review, read_review
from kindred.plans.linker import Linker, dedupe, link, load
from kindred.plans.provenance import fingerprint
from kindred.sources.datasets import load_dataset, sample_left, write_dataset
from kindred.sources.lines import parse_record, read_pairs
from kindred.sources.tables import read_table, stata_value_labels, write_table

ON = [("name", "firm"), ("state", "st")]


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([("001", "Acme Corp", "NY"), ("NA", "Beta Works", "CA"), ("003", "Gamma", None)], "gvkey string, name string, state string")
    right = spark.createDataFrame([(1, "ACME corp.", "ny"), (2, "Beta Work", "CA"), (3, "Acme Corp", "NY")], "id long, firm string, st string")
    return left, right


def run(sides, **options):
    return Linker(ColumnJudge(F.col("sim"), "sim"), ON, "firm", blockers=[ngrams(("name", "firm"), k=3)], **{k: options.pop(k) for k in ("price", "exact_shortcut") if k in options}).link(*sides, left_id="gvkey", right_id="id", **options)


def test_link_save_load_relink_resume(sides, spark, tmp_path):
    with pytest.warns(UserWarning, match="unjudged"):
        r = run(sides, how="many-to-one", budget=0.01, price=0.01)
    assert r.scores.where("source = 'jev'").count() == 1 and r.scores.where("source = 'unjudged'").count() >= 1
    r.save(str(tmp_path / "run"))
    again = load(spark, str(tmp_path / "run"))
    assert sorted(map(tuple, again.links.select("left_id", "right_id").collect())) == sorted(map(tuple, r.links.select("left_id", "right_id").collect()))
    full = again.resume(*sides, judge_with=ColumnJudge(F.col("sim"), "sim"), budget=None)
    assert full.scores.where("source = 'unjudged'").count() == 0
    assert full.relink(how="many-to-many", threshold=0.0).links.count() == full.scores.count()
    with pytest.raises(ValueError, match="differs"):
        again.resume(sides[0].limit(1), sides[1], judge_with=ColumnJudge(F.col("sim")), budget=None)
    m = full.merged(*sides)
    assert {"name", "firm", "p", "margin"} <= set(m.columns) and "Question" in full.report() and "passes" in r.methods()
    assert full.audit_sample(5).count() <= 5


def test_judges_share_isolate_and_cache(sides):
    left, right = sides
    c = left.select(F.col("gvkey").alias("left_id")).crossJoin(right.select(F.col("id").alias("right_id"))).withColumn("block", F.lit("b")).withColumn("sim", F.lit(0.5))
    args = dict(on=ON, left_id="gvkey", right_id="id", entity="firm", budget=None)

    def flaky(body):
        if "Gamma" in body["record_a"]["name"]:
            raise OSError("no answer")
        return 0.25

    s = judge(c, left, right, HttpJudge(flaky, question("firm")), **args)
    assert {r.source: r.n for r in s.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"jev": 6, "error": 3}

    def fatal(body):
        raise FatalError("no credit")

    with pytest.raises(Exception, match="no credit"):
        judge(c, left, right, HttpJudge(fatal, question("firm")), **args)
    p = judge(c, left, right, PandasJudge(lambda b: b["sim"] * 0 + 0.75), exact_shortcut=True, **args)
    assert p.where("source = 'exact'").count() == 2 and p.where("p = 0.75").count() == 7
    none = judge(c, left, right, ColumnJudge(F.col("sim")), **(args | {"budget": 0.0}), price=0.01)
    assert none.where("source <> 'unjudged'").count() == 0
    for bad in ({"entity": None}, {"style": "rule"}, {"budget": -1.0}):
        with pytest.raises(ValueError):
            judge(c, left, right, ColumnJudge(F.col("sim")), **(args | bad))


def test_dedupe(spark):
    df = spark.createDataFrame([("r1", "Acme Corp"), ("r2", "ACME corp"), ("r3", "Other"), ("r4", None)], "rid string, name string")
    r = dedupe(df, ColumnJudge(F.col("sim"), "sim"), on=["name"], id="rid", entity="firm", blockers=[exact("name")], budget=None)
    assert {x.id: x.cluster_id for x in r.clusters.collect()} == {"r1": 0, "r2": 0, "r3": 1, "r4": 2}
    assert r.links.count() == 1 and r.split_pairs().count() == 0 and r.labeled().count() == 4 and "Clusters: 3" in r.report()
    assert r.recluster(threshold=1.0, linkage="components").clusters.count() == 4


def test_review_round_trip(sides, spark, tmp_path):
    r = run(sides, how="many-to-one", budget=None)
    v = create_review(r)
    v.decide("003", 2, "accept", reviewer="me") if ("003", "2") in v.pairs else v.decide("001", 3, "reject", reviewer="me")
    v.save(str(tmp_path / "v.json"))
    w = read_review(str(tmp_path / "v.json"))
    assert w.apply(spark).count() >= 1 and v.merge(w).run_id == w.run_id
    w.write_html(str(tmp_path / "v.html"))
    assert "<script" in (tmp_path / "v.html").read_text() and "\\u003c" not in json.dumps({})
    with pytest.raises(ValueError):
        w.decide("zz", 1, "accept", reviewer="me")


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("NA", 1.0), (None, float("nan")), ("x", None)], "s string, d double")
    assert fingerprint(a)["sha256"] == fingerprint(a.orderBy(F.desc("s")).repartition(3))["sha256"]
    assert fingerprint(a)["sha256"] != fingerprint(a.union(a.limit(1)))["sha256"]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("NA", "a,\"b\"\nc", 1), (None, "=x", 2)], "s string, t string, n int")
    for suffix in ("csv", "tsv"):
        path = str(tmp_path / f"t.{suffix}")
        write_table(df, path)
        assert sorted(map(tuple, read_table(spark, path).collect()), key=lambda r: r[2]) == [("NA", 'a,"b"\nc', "1"), (None, "=x", "2")]
    write_table(df, str(tmp_path / "t.dta"))
    assert [r.n for r in read_table(spark, str(tmp_path / "t.dta")).orderBy("n").collect()] == [1, 2]
    assert stata_value_labels(str(tmp_path / "t.dta"), "n") == {}
    write_table(df, str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path / "t.parquet")).count() == 2
    with pytest.raises(ValueError):
        read_table(spark, "t.xls")


def test_lines_and_datasets(spark, tmp_path):
    df = spark.createDataFrame([("COL a VAL x y COL b VAL ",), ('{"a": "1", "b": " "}',), ("COL a VAL 1 COL a VAL 2",), ("noise",)], "line string")
    assert [dict(r[0] or {}) for r in df.select(parse_record(F.col("line"))).collect()] == [{"a": "x y"}, {"a": "1"}, {"a": "2"}, {}]
    (tmp_path / "p.txt").write_text("COL n VAL a\tCOL n VAL b\t1\nCOL n VAL c\tCOL n VAL d\t0\n")
    assert [r.label for r in read_pairs(spark, str(tmp_path / "p.txt")).collect()] == [1, 0]
    l, r = spark.range(5).selectExpr("cast(id as string) id"), spark.range(5).selectExpr("cast(id as string) id")
    t = l.select(F.col("id").alias("left_id"), F.col("id").alias("right_id"))
    assert write_dataset(str(tmp_path), l, r, t, {"entity": "x"})["n_truth"] == 5
    assert load_dataset(spark, str(tmp_path))[3]["entity"] == "x"
    few, ft = sample_left(l, t, 2)
    assert few.count() == ft.count() == 2
    with pytest.raises(ValueError):
        write_dataset(str(tmp_path), l.union(l), r, t, {})


def test_block_rules():
    assert cli.block_rule("exact:a+b=c").name == "exact:a,b=c" and cli.block_rule("ngrams-reverse:a:3").k == 3
    w = cli.block_rule("window:p=o:0..3d")
    assert (w.low, w.high, w.unit) == (0.0, 3.0, "days") and cli.block_rule("within:s:within:t:exact:a").inner.inner.name == "exact:a"
    for bad in ("exact", "ngrams:a:x", "window:a", "window:a+b:3", "nope:a", "within:a"):
        with pytest.raises(ValueError):
            cli.block_rule(bad)


def test_cli(sides, spark, tmp_path, capsys):
    write_table(sides[0], str(tmp_path / "l.csv"))
    write_table(sides[1], str(tmp_path / "r.csv"))
    p = lambda n: str(tmp_path / n)
    base = [p("l.csv"), p("r.csv"), "--on", "name=firm", "--entity", "firm", "--left-id", "gvkey", "--right-id", "id", "--block", "ngrams:name=firm:3"]
    assert cli.main(["link", *base, "-o", p("links.csv"), "--scores", p("scores.csv"), "--save", p("run"), "--report", p("r.md")], spark) == 0
    assert cli.main(["estimate", *base], spark) == 0 and "pairs:" in capsys.readouterr().out
    assert cli.main(["audit", p("scores.csv"), "-n", "3", "-o", p("audit.csv")], spark) == 0
    rows = (tmp_path / "audit.csv").read_text().splitlines()
    (tmp_path / "done.csv").write_text("\n".join([rows[0], *("yes" + r for r in rows[1:])]))
    assert cli.main(["evaluate", p("done.csv")], spark) == 0 and "precision" in capsys.readouterr().out
    assert cli.main(["dedupe", p("l.csv"), "--on", "name", "--entity", "firm", "--id", "gvkey", "-o", p("c.csv"), "--scores", p("ds.csv")], spark) == 0
    assert cli.main(["cluster", p("ds.csv"), "--records", p("l.csv"), "--id", "gvkey"], spark) == 0
    assert cli.main(["review", "create", p("run"), "--left", p("l.csv"), "--right", p("r.csv"), "-o", p("v.json")], spark) == 0
    assert cli.main(["review", "apply", p("v.json"), "-o", p("v.csv")], spark) == 0
    assert cli.main(["link", *base, "-o", p("l.csv")], spark) == 2 and "kindred:" in capsys.readouterr().err


def test_one_call_link(sides):
    with pytest.raises(ValueError):
        link(*sides, ColumnJudge(F.lit(1.0)), on=ON, left_id="gvkey", right_id="id", entity="")


def test_core_stands_alone():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "kindred"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "kindred.llm" not in f.read_text(), f


def test_own_pass_is_checked(spark):
    from kindred.operators.candidates import candidates
    from kindred.operators.passes import Pass

    class Odd(Pass):
        name = "odd"

        def __init__(self, rows):
            self.rows = rows

        def pairs(self, left, right, groups=()):
            return spark.createDataFrame(self.rows, "l string, r string")

    t = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, n string")
    run = lambda rows: candidates(t, t, on=["n"], blockers=[Odd(rows)], left_id="id", right_id="id", with_sim=False).frame.collect()
    assert [(r.left_id, r.right_id) for r in run([("a", "b"), ("a", "b")])] == [("a", "b")]
    for bad in ([("a", "q")], [(None, "b")], [("a", None)]):
        with pytest.raises(ValueError, match="lacks"):
            run(bad)


def test_transport_asks_again_and_gives_up():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from kindred.operators.judge import FatalError, JsonTransport

    codes = [503, 429, 200, 400, 401]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert body["model"] == "m" and body["question"] == "q"
            self.send_response(codes.pop(0))
            self.end_headers()
            self.wfile.write(json.dumps({"p": 0.25}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = JsonTransport(f"http://127.0.0.1:{server.server_port}", "m", wait=0.01)
    try:
        assert ask({"question": "q"}) == 0.25
        with pytest.raises(OSError):
            ask({"question": "q"})
        with pytest.raises(FatalError):
            ask({"question": "q"})
    finally:
        server.shutdown()


def test_answers_are_kept(spark, tmp_path):
    from kindred.operators.judge import add_to_cache, read_cache

    path = str(tmp_path / "answers")
    assert read_cache(spark, path) is None
    one = spark.createDataFrame([("s", 0.5, 1.0)], "state string, p double, answered_at double")
    add_to_cache(one, path)
    add_to_cache(one.union(spark.createDataFrame([("t", 0.7, 2.0)], one.schema)), path)
    assert sorted(r.state for r in read_cache(spark, path).collect()) == ["s", "t"]
