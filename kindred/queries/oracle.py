"""The same results as SQL for DuckDB."""

from __future__ import annotations

_WIDE = "".join(chr(0xFF01 + i) for i in range(94)).replace("'", "''")
_NARROW = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def norm(x: str) -> str:
    """Comparable text: width forms and the joined letters of the tables apart, no case, accents or signs."""
    wide = f"replace(replace(translate(CAST({x} AS VARCHAR), '{_WIDE}', '{_NARROW}'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    folded = f"replace(replace(lower(strip_accents({wide})), 'ß', 'ss'), 'ς', 'σ')"
    return rf"coalesce(trim(regexp_replace(replace({folded}, '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '')"


def key(x: str) -> str:
    return norm(rf"regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '^([+-]?[0-9]+)\.0+$', '\1')")


#: DuckDB compares bytes where names are compared by characters: other letters are exchanged for unused single bytes first.
_OTHER = "ø" + "".join(map(chr, range(0x430, 0x450))) + "ѕіјһԝԁӏѵ" + "".join(map(chr, range(0x3B1, 0x3CA)))
_BYTES = "".join(chr(c) for c in range(1, 127) if not chr(c).islower() and not chr(c).isdigit() and chr(c) not in " '")[: len(_OTHER)]


def jw(x: str, y: str) -> str:
    one = lambda v: "translate(" + v + ", '" + _OTHER + "', " + " || ".join(f"chr({ord(c)})" for c in _BYTES) + ")"
    return f"jaro_winkler_similarity({one(x)}, {one(y)})"


def _with(*names: str) -> str:
    """The named common tables and all that they need."""
    need: list[str] = []

    def add(n: str) -> None:
        for m in _USES.get(n, ()):
            add(m)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_TABLES[n]})" for n in need) + "\n"


def _grams(text: str, low: int, high: int) -> str:
    """A list of the n-grams inside the words of normalized text."""
    parts = " || ".join(f"CASE WHEN length(w) >= {n} THEN list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, CAST(i AS INT), {n})) ELSE [] END" for n in range(low, high + 1))
    words = f"list_transform(list_filter(string_split({text}, ' '), lambda x: x <> ''), lambda x: ' ' || x || ' ')"
    return f"flatten(list_transform({words}, lambda w: CASE WHEN length(w) < {low} THEN [w] ELSE {parts} END))"


def _tfidf(prefix: str, left: str, right: str, groups: str = "", grams: str | None = None) -> dict[str, str]:
    """Common tables of unit vectors of two row sets (id, text, groups): <prefix>_l and <prefix>_r with (text, groups, gram, w)."""
    g = f", {groups}" if groups else ""
    using = f"USING ({groups})" if groups else "ON true"
    grams = grams or _grams("text", 2, 4)
    return {
        f"{prefix}_rows": f"SELECT text{g}, 1 AS l, 0 AS r FROM ({left}) UNION ALL SELECT text{g}, 0, 1 FROM ({right})",
        f"{prefix}_texts": f"SELECT text{g}, count(*) AS n, max(l) AS l, max(r) AS r FROM {prefix}_rows GROUP BY ALL",
        f"{prefix}_tf": f"SELECT text{g}, gram, count(*) AS tf, any_value(n) AS n, any_value(l) AS l, any_value(r) AS r FROM (SELECT *, unnest({grams}) AS gram FROM {prefix}_texts) GROUP BY text{g}, gram",
        f"{prefix}_df": f"SELECT gram{g}, sum(n) AS df FROM {prefix}_tf GROUP BY gram{g}",
        f"{prefix}_n": f"SELECT {groups + ',' if groups else ''} sum(n) AS total FROM {prefix}_texts {'GROUP BY ' + groups if groups else ''}",
        f"{prefix}_w": f"SELECT t.*, t.tf * (ln((1.0 + total) / (1.0 + df)) + 1.0) AS raw FROM {prefix}_tf t JOIN {prefix}_df USING (gram{g}) JOIN {prefix}_n {using}",
        f"{prefix}_unit": f"SELECT text{g}, gram, raw / sqrt(sum(raw * raw) OVER (PARTITION BY text{g})) AS w, l, r FROM {prefix}_w",
        f"{prefix}_cos": f"SELECT a.text AS lt, b.text AS rt{', ' + ', '.join('a.' + x.strip() for x in groups.split(',')) if groups else ''}, least(1.0, greatest(0.0, round(sum(a.w * b.w), 12))) AS sim FROM {prefix}_unit a JOIN {prefix}_unit b USING (gram{g}) WHERE a.l = 1 AND b.r = 1 GROUP BY ALL",
    }


_F, _A = "compustat_sample", "patent_assignees"
_TABLES = {
    "s": "SELECT left_id, right_id, min(block) AS block, max(sim) AS sim, max(CASE WHEN NOT isnan(p) THEN p END) AS p FROM result_scores GROUP BY 1, 2",
    "l": "SELECT DISTINCT left_id, right_id FROM result_links",
    "c0": "SELECT id, min(cluster_id) AS cluster_id FROM dedupe_clusters GROUP BY 1",
    "c": "SELECT id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM c0",
    "f": f"SELECT *, {key('conm')} AS kn, {key('state')} AS ks, {key('city')} AS kc, CAST(year AS VARCHAR) AS ky FROM {_F}",
    "a": f"SELECT *, {key('assignee')} AS kn, {key('state')} AS ks, {key('city')} AS kc, CAST(year AS VARCHAR) AS ky FROM {_A}",
    "t": "SELECT gvkey AS left_id, assignee_id AS right_id FROM f JOIN a USING (kn, ks, kc) WHERE kn <> '' AND ks <> '' AND kc <> ''",
    "labels": """SELECT s.left_id, s.right_id, s.p, s.sim, 1.0 + s.sim AS weight,
        CASE WHEN s.p <= 0.05 THEN '[0, 0.05]' WHEN s.p <= 0.2 THEN '(0.05, 0.2]' WHEN s.p <= 0.5 THEN '(0.2, 0.5]' WHEN s.p <= 0.8 THEN '(0.5, 0.8]' WHEN s.p <= 0.95 THEN '(0.8, 0.95]' ELSE '(0.95, 1]' END AS bin,
        CASE WHEN md5(s.left_id || '|' || s.right_id)[1] IN ('0', 'f') THEN NULL WHEN t.left_id IS NOT NULL THEN 1 ELSE 0 END AS y, l.left_id IS NOT NULL AS sel
        FROM s LEFT JOIN t USING (left_id, right_id) LEFT JOIN l USING (left_id, right_id) WHERE s.p IS NOT NULL""",
    "lw": """SELECT *, weight * CASE WHEN count(*) FILTER (y IS NULL) OVER b > 0 AND sum(weight) FILTER (y IS NOT NULL) OVER b > 0
        THEN sum(weight) OVER b / sum(weight) FILTER (y IS NOT NULL) OVER b ELSE 1.0 END AS w FROM labels WINDOW b AS (PARTITION BY bin)""",
    "d0": "SELECT assignee_id AS id, kn, kc, ky, year FROM a",
    "dc": """SELECT DISTINCT x.id AS left_id, y.id AS right_id, 'e' AS b FROM d0 x JOIN d0 y USING (kn) WHERE kn <> '' AND x.id < y.id
        UNION SELECT DISTINCT x.id, y.id, 'w' FROM d0 x JOIN d0 y USING (kc) WHERE kc <> '' AND x.id < y.id AND abs(x.year - y.year) <= 1""",
    "selfs": """SELECT left_id, right_id, (2 * CASE WHEN x.kn = y.kn AND x.kn <> '' THEN 1 ELSE 0 END + CASE WHEN x.kc = y.kc AND x.kc <> '' THEN 1 ELSE 0 END + CASE WHEN x.year = y.year THEN 1 ELSE 0 END) / 4.0 AS p
        FROM (SELECT DISTINCT left_id, right_id FROM dc) JOIN d0 x ON x.id = left_id JOIN d0 y ON y.id = right_id""",
    "m1": "SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY p DESC, sim DESC, right_id) AS k FROM s WHERE p >= 0.5",
    "mg": """SELECT a.left_id, a.right_id, a.p, a.sim, a.block, round(a.p - greatest(
          (SELECT max(b.p) FROM s b WHERE b.left_id = a.left_id AND b.right_id <> a.right_id), (SELECT max(b.p) FROM s b WHERE b.right_id = a.right_id AND b.left_id <> a.left_id)), 9) AS margin FROM s a""",
    "dec": """SELECT left_id, arg_max(right_id, (p, right_id)) AS right_id, 'accept' AS decision FROM s WHERE p IS NOT NULL AND md5(left_id)[1] < '8' GROUP BY 1
        UNION ALL SELECT left_id, arg_min(right_id, (p, right_id)), 'reject' FROM s WHERE p IS NOT NULL AND md5(left_id)[1] >= '8' GROUP BY 1""",
    "pt": f"SELECT left_id, right_id, y, p, {norm('conm')} AS lt, {norm('assignee')} AS rt FROM labels JOIN f ON gvkey = left_id JOIN a ON assignee_id = right_id WHERE y IS NOT NULL",
    "tn": _tfidf("tn", f"SELECT {norm('conm')} AS text FROM {_F}", f"SELECT {norm('assignee')} AS text FROM {_A}")["tn_rows"],
}
_USES = {"t": ("f", "a"), "c": ("c0",), "labels": ("s", "t", "l"), "lw": ("labels",), "d0": ("a",), "dc": ("d0",), "selfs": ("d0", "dc"), "m1": ("s",), "mg": ("s",), "dec": ("s",), "pt": ("labels", "f", "a")}


def _add(prefix: str, tables: dict[str, str], uses: tuple[str, ...] = ()) -> str:
    before: tuple[str, ...] = uses
    for n, q in tables.items():
        _TABLES[n], _USES[n] = q, before
        before = (n,)
    return f"{prefix}_cos"


_add("tn", _tfidf("tn", f"SELECT {norm('conm')} AS text FROM {_F}", f"SELECT {norm('assignee')} AS text FROM {_A}"))
_add("tc", _tfidf("tc", f"SELECT trim({norm('conm')} || ' ' || {norm('city')}) AS text FROM {_F}", f"SELECT trim({norm('assignee')} || ' ' || {norm('city')}) AS text FROM {_A}"))
_add("ts", _tfidf("ts", f"SELECT trim({norm('conm')} || ' ' || {norm('state')}) AS text FROM {_F}", f"SELECT trim({norm('assignee')} || ' ' || {norm('state')}) AS text FROM {_A}"))
_add("ty", _tfidf("ty", f"SELECT {norm('city')} AS text FROM {_F}", f"SELECT {norm('city')} AS text FROM {_A}"))
_add("tg", _tfidf("tg", f"SELECT {norm('conm')} AS text, kc FROM f WHERE kc <> ''", f"SELECT {norm('assignee')} AS text, kc FROM a WHERE kc <> ''", "kc"), ("f", "a"))
_add("tsy", _tfidf("tsy", f"SELECT {norm('conm')} AS text, ks, ky FROM f WHERE ks <> '' AND ky <> ''", f"SELECT {norm('assignee')} AS text, ks, ky FROM a WHERE ks <> '' AND ky <> ''", "ks, ky"), ("f", "a"))
_whole = " || ".join(f"CASE WHEN length(text) >= {n} THEN list_transform(range(1, length(text) - {n} + 2), lambda i: substr(text, CAST(i AS INT), {n})) ELSE [] END" for n in (2, 3, 4))
_add("tw", _tfidf("tw", f"SELECT {norm('conm')} AS text FROM {_F}", f"SELECT {norm('assignee')} AS text FROM {_A}", grams=f"({_whole})"))


def _knn(cos: str, lt: str, rt: str, k: int, least: float, reverse: bool = False, on: str = "") -> str:
    part, tie = ("r.assignee_id", "l.gvkey") if reverse else ("l.gvkey", "r.assignee_id")
    g = "".join(f" AND l.{x} = c.{x} AND r.{x} = c.{x}" for x in on.split(",") if x)
    return f"""SELECT l.gvkey AS left_id, r.assignee_id AS right_id FROM {cos} c JOIN f l ON {lt} = c.lt JOIN a r ON {rt} = c.rt
    WHERE c.sim >= {least} AND c.sim > 0{g} QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY c.sim DESC, {tie}) <= {k}"""


_LN, _RN = norm("l.conm"), norm("r.assignee")
_UNION3 = """u AS (SELECT l, r, bit_or(b) AS mask FROM (
  SELECT gvkey AS l, assignee_id AS r, 1 AS b FROM f JOIN a USING (kn) WHERE kn <> ''
  UNION ALL SELECT gvkey, assignee_id, 2 FROM f JOIN a ON f.kc = a.kc AND f.kc <> '' AND abs(f.year - a.year) <= 1
  UNION ALL SELECT gvkey, assignee_id, 4 FROM f JOIN a USING (kc, ks, ky) WHERE kc <> '' AND ks <> '' AND ky <> '') GROUP BY 1, 2)"""
_UNION_NAMES = "concat_ws('+', CASE WHEN mask & 1 <> 0 THEN 'exact:conm=assignee' END, CASE WHEN mask & 2 <> 0 THEN 'within:city(window:year[-1..1])' END, CASE WHEN mask & 4 <> 0 THEN 'exact:city,state,year' END)"
_UNION_SIM = f"""u2 AS (SELECT u.*, {_UNION_NAMES} AS block, trim({_LN} || ' ' || {norm("l.city")}) AS lt, trim({_RN} || ' ' || {norm("r.city")}) AS rt FROM u JOIN f l ON l.gvkey = u.l JOIN a r ON r.assignee_id = u.r),
u3 AS (SELECT lt, rt, least(1.0, greatest(0.0, round(sum(x.w * y.w), 12))) AS sim FROM (SELECT DISTINCT lt, rt FROM u2) p JOIN tc_unit x ON x.text = lt AND x.l = 1 JOIN tc_unit y ON y.text = rt AND y.r = 1 AND x.gram = y.gram GROUP BY 1, 2),
u4 AS (SELECT u2.l AS left_id, u2.r AS right_id, block, coalesce(CASE WHEN abs(sim - 1) <= 1e-11 THEN 1.0 ELSE sim END, 0.0) AS sim FROM u2 LEFT JOIN u3 USING (lt, rt))"""


def _metrics(z: str) -> str:
    return _with("lw") + f"""SELECT CASE WHEN least_k > 0 AND pred > 0 THEN round(tp / pred, 6) END AS precision, CASE WHEN least_k > 0 AND tru > 0 THEN round(tp / tru, 6) END AS recall,
    CASE WHEN least_k > 0 AND pred + tru > 0 THEN round(2 * tp / (pred + tru), 6) END AS f1, CASE WHEN least_k > 0 THEN round(brier, 6) END AS brier, n_labeled, n_unlabeled
    FROM (SELECT sum(w * y * z) AS tp, sum(w * z) AS pred, sum(w * y) AS tru, sum(w * (p - y) * (p - y)) / sum(w) AS brier, count(*) AS n_labeled FROM (SELECT *, CASE WHEN {z} THEN 1 ELSE 0 END AS z FROM lw WHERE y IS NOT NULL)),
    (SELECT sum(u) AS n_unlabeled, min(k) AS least_k FROM (SELECT count(y) AS k, count(*) FILTER (y IS NULL) AS u FROM labels GROUP BY bin))"""


_STOP = ", ".join(f"'{w}'" for w in "and of the for inc corp co ltd llc plc company corporation incorporated limited".split())


def _forms(table: str, id: str, name: str) -> str:
    n = norm(name)
    words = f"list_filter(string_split(n, ' '), lambda w: w <> '' AND w NOT IN ({_STOP}))"
    ini = f"array_to_string(list_transform({words}, lambda w: w[1]), '')"
    return rf"SELECT id, CASE WHEN regexp_matches(n, '^\p{{L}}+$') AND length(n) >= 2 THEN n END AS acronym, CASE WHEN length({ini}) >= 2 THEN {ini} END AS expansion FROM (SELECT {id} AS id, {n} AS n FROM {table})"


_SPLIT_EDGES = f"""recs AS (SELECT 'left' AS side, gvkey AS id, 'l' || gvkey AS node, {norm('conm')} AS text FROM {_F} UNION ALL SELECT 'right', assignee_id, 'r' || assignee_id, {norm('assignee')} FROM {_A}),
e AS (SELECT 'l' || left_id AS x, 'r' || right_id AS y FROM t UNION SELECT node, min(node) OVER (PARTITION BY text) FROM recs WHERE text <> ''),
e2 AS (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y),
reach AS (SELECT node AS n, node AS m FROM recs UNION SELECT reach.n, e2.y FROM reach JOIN e2 ON reach.m = e2.x),
comp AS (SELECT n AS node, min(m) AS component FROM reach GROUP BY 1),
rk AS (SELECT component, row_number() OVER (ORDER BY sha256('1729|' || component), component) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT component FROM comp))"""
_SELF_COMP = """edges AS (SELECT left_id AS x, right_id AS y FROM selfs WHERE p >= 0.5 UNION SELECT right_id, left_id FROM selfs WHERE p >= 0.5),
reach AS (SELECT id AS n, id AS m FROM d0 UNION SELECT reach.n, edges.y FROM reach JOIN edges ON reach.m = edges.x),
comp AS (SELECT n AS id, min(m) AS first FROM reach GROUP BY 1)"""
_JSONV = r"json_extract_string(CAST(line AS JSON), '$.{0}')"
_COLV = r"nullif(trim(regexp_extract(line, '(?s)COL\s+{0}\s+VAL\s*(.*?)\s*(?:COL\s+\S+\s+VAL|$)', 1), ' ' || chr(9) || chr(10) || chr(13)), '')"

SQL: dict[str, str] = {
    "normalize_names": f"SELECT assignee_id, {norm('assignee')} AS name FROM {_A}",
    "clean_values": rf"SELECT gvkey, nullif(regexp_replace(conm, '^\s+|\s+$', '', 'g'), '') AS conm, nullif(regexp_replace(state, '^\s+|\s+$', '', 'g'), '') AS state, CAST(year AS VARCHAR) AS founded FROM {_F}",
    "key_text_firms": f"SELECT gvkey, {key('conm')} AS name_key, coalesce(CAST(year AS VARCHAR), '') AS double_key, coalesce(CAST(year AS VARCHAR), '') AS text_key, coalesce(CAST(year AS VARCHAR), '') AS int_key FROM {_F}",
    "record_text_firms": f"SELECT gvkey, trim({norm('conm')} || ' ' || {norm('state')} || ' ' || {norm('city')}) AS text FROM {_F}",
    "acronyms": f"SELECT id AS gvkey, acronym, expansion FROM ({_forms(_F, 'gvkey', 'conm')})",
    "word_ngrams": f"SELECT gram, count(*) AS n, count(DISTINCT gvkey) AS firms FROM (SELECT gvkey, unnest({_grams('n', 2, 4)}) AS gram FROM (SELECT gvkey, {norm('conm')} AS n FROM {_F})) GROUP BY 1",
    "text_ngrams": f"SELECT gram, count(*) AS n FROM (SELECT unnest(CASE WHEN length(n) >= 3 THEN list_transform(range(1, length(n) - 1), lambda i: substr(n, CAST(i AS INT), 3)) ELSE [] END) AS gram FROM (SELECT {norm('conm')} AS n FROM {_F})) GROUP BY 1",
    "tfidf_weights": _with("tn_unit") + "SELECT text, gram, round(w, 6) AS w FROM tn_unit WHERE l = 1",
    "name_similarity": f"SELECT left_id, right_id, round(CASE WHEN a = '' OR b = '' THEN CASE WHEN a = b THEN 1.0 ELSE 0.0 END ELSE {jw('a', 'b')} END, 6) AS jw FROM (SELECT DISTINCT left_id, right_id FROM result_scores) JOIN (SELECT gvkey AS left_id, {norm('conm')} AS a FROM {_F}) USING (left_id) JOIN (SELECT assignee_id AS right_id, {norm('assignee')} AS b FROM {_A}) USING (right_id)",
    "guarded_cells": rf"SELECT assignee_id, CASE WHEN regexp_matches(ltrim(assignee), '^[=+\-@]') OR regexp_matches(assignee, '^[\t\r]') THEN '''' || assignee ELSE assignee END AS cell FROM {_A}",
    "parsed_lines": "SELECT line_id, " + ", ".join(rf"CASE WHEN ltrim(line) LIKE '{{%' THEN CASE WHEN length(trim({_JSONV.format(c)})) > 0 THEN {_JSONV.format(c)} END ELSE {_COLV.format(c)} END AS {c}" for c in ("conm", "assignee", "state", "city", "year")) + " FROM record_lines",
    "block_exact": _with("f", "a") + "SELECT gvkey AS left_id, assignee_id AS right_id FROM f JOIN a USING (kn) WHERE kn <> ''",
    "block_exact_fields": _with("f", "a") + "SELECT gvkey AS left_id, assignee_id AS right_id FROM f JOIN a USING (kn, ks, kc, ky) WHERE kn <> '' AND ks <> '' AND kc <> ''",
    "block_initials": f"WITH x AS ({_forms(_F, 'gvkey', 'conm')}), y AS ({_forms(_A, 'assignee_id', 'assignee')}) SELECT DISTINCT x.id AS left_id, y.id AS right_id FROM x JOIN y ON x.acronym = y.expansion UNION SELECT DISTINCT x.id, y.id FROM x JOIN y ON x.expansion = y.acronym",
    "block_ngrams": _with("tn_cos", "f", "a") + _knn("tn_cos", _LN, _RN, 10, 0.1),
    "block_ngrams_reverse": _with("tn_cos", "f", "a") + _knn("tn_cos", _LN, _RN, 10, 0.1, True),
    "block_ngrams_fields": _with("tc_cos", "f", "a") + _knn("tc_cos", f"trim({_LN} || ' ' || {norm('l.city')})", f"trim({_RN} || ' ' || {norm('r.city')})", 5, 0.3),
    "block_ngrams_padded": _with("ty_cos", "f", "a") + f"SELECT l.gvkey AS left_id, r.assignee_id AS right_id FROM f l CROSS JOIN a r LEFT JOIN ty_cos c ON c.lt = {norm('l.city')} AND c.rt = {norm('r.city')} QUALIFY row_number() OVER (PARTITION BY l.gvkey ORDER BY coalesce(c.sim, 0) DESC, r.assignee_id) <= 3",
    "block_window_year": _with("f", "a") + "SELECT gvkey AS left_id, assignee_id AS right_id FROM f JOIN a ON f.kc = a.kc AND f.kc <> '' AND abs(f.year - a.year) <= 2",
    "block_window_days": _with("f", "a") + "SELECT gvkey AS left_id, assignee_id AS right_id FROM f JOIN a ON f.ks = a.ks AND f.ks <> '' AND f.loaded_at - a.loaded_at BETWEEN INTERVAL 0 DAY AND INTERVAL 72 HOUR",
    "block_window_events": "SELECT l.event_id AS left_id, r.event_id AS right_id FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'purchase' AND r.event_type = 'signup' AND l.ts - r.ts BETWEEN INTERVAL 0 MINUTE AND INTERVAL 60 MINUTE",
    "block_window_balance": "SELECT c_custkey AS left_id, s_suppkey AS right_id FROM customer JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal BETWEEN c_acctbal - 25.0 AND c_acctbal + 25.0",
    "window_dropped": "SELECT 'left' AS side, 'source' AS column_name, count(*) FILTER (source IS NULL) AS missing, count(*) FILTER (source IS NOT NULL) AS unparseable FROM documents UNION ALL SELECT 'right', 'published', count(*) FILTER (published IS NULL), 0 FROM documents",
    "block_within_exact": _with("f", "a") + "SELECT gvkey AS left_id, assignee_id AS right_id FROM f JOIN a USING (kn, ks) WHERE kn <> '' AND ks <> ''",
    "block_within_match": _with("f", "a") + "SELECT gvkey AS left_id, assignee_id AS right_id FROM f JOIN a USING (kn, ks) WHERE kn <> ''",
    "block_within_ngrams": _with("tg_cos", "f", "a") + _knn("tg_cos", _LN, _RN, 3, 0.1, on="kc"),
    "block_embeddings": "SELECT l.vec_id AS left_id, r.vec_id AS right_id FROM embeddings l CROSS JOIN embeddings r WHERE list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) >= 0 QUALIFY row_number() OVER (PARTITION BY l.vec_id ORDER BY round(list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 12) DESC, r.vec_id) <= 5",
    "block_embeddings_reverse": "SELECT l.vec_id AS left_id, r.vec_id AS right_id FROM embeddings l JOIN embeddings r ON l.label = r.label WHERE round(list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 12) >= 0.2 QUALIFY row_number() OVER (PARTITION BY r.vec_id ORDER BY round(list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 12) DESC, l.vec_id) <= 3",
    "candidates_union": _with("f", "a", "tc_unit").rstrip() + ",\n" + _UNION3 + ",\n" + _UNION_SIM + " SELECT left_id, right_id, block, round(sim, 6) AS sim FROM u4",
    "blocking_diagnostics": _with("f", "a").rstrip() + ",\n" + _UNION3 + """, pr AS (SELECT 0 AS pass, (SELECT count(*) FROM f JOIN a USING (kn) WHERE kn <> '') AS n UNION ALL SELECT 1, (SELECT count(*) FROM f JOIN a ON f.kc = a.kc AND f.kc <> '' AND abs(f.year - a.year) <= 1)
      UNION ALL SELECT 2, (SELECT count(*) FROM f JOIN a USING (kc, ks, ky) WHERE kc <> '' AND ks <> '' AND ky <> ''))
      SELECT pr.pass, ['exact:conm=assignee', 'within:city(window:year[-1..1])', 'exact:city,state,year'][pr.pass + 1] AS name, pr.n AS proposed_pairs, count(*) FILTER (mask & (1 << pass) <> 0) AS unique_pairs, count(*) FILTER (mask & (1 << pass) <> 0 AND mask & ((1 << pass) - 1) = 0) AS added_pairs,
      count(*) FILTER (mask & (1 << pass) <> 0 AND mask & ((1 << pass) - 1) <> 0) AS overlapping_pairs, count(*) FILTER (mask & ((1 << (pass + 1)) - 1) <> 0) AS union_pairs, count(*) FILTER (mask = 1 << pass) AS exclusive_pairs FROM pr CROSS JOIN u GROUP BY 1, 2, 3""",
    "pair_similarities": _with("ts_unit", "l", "f", "a").rstrip() + f""", p AS (SELECT l.left_id, l.right_id, trim({norm("x.conm")} || ' ' || {norm("x.state")}) AS lt, trim({norm("y.assignee")} || ' ' || {norm("y.state")}) AS rt FROM l JOIN f x ON x.gvkey = l.left_id JOIN a y ON y.assignee_id = l.right_id),
      q AS (SELECT lt, rt, sum(u.w * v.w) AS sim FROM (SELECT DISTINCT lt, rt FROM p) z JOIN ts_unit u ON u.text = lt JOIN ts_unit v ON v.text = rt AND u.gram = v.gram GROUP BY 1, 2) SELECT left_id, right_id, round(CASE WHEN sim IS NULL THEN 0.0 ELSE least(1.0, sim) END, 6) AS sim FROM p LEFT JOIN q USING (lt, rt)""",
    "dedupe_candidates": _with("dc") + "SELECT left_id, right_id, array_to_string(list_sort(list(DISTINCT CASE b WHEN 'e' THEN 'exact:assignee' ELSE 'within:city(window:year[-1..1])' END)), '+') AS block FROM dc GROUP BY 1, 2",
    "default_candidates": _with("tsy_cos", "f", "a").rstrip() + f""", x AS ({_knn("tsy_cos", _LN, _RN, 2, 0.1, on="ks,ky")}), y AS ({_knn("tsy_cos", _LN, _RN, 2, 0.1, True, on="ks,ky")})
      SELECT left_id, right_id, string_agg(b, '+' ORDER BY length(b)) AS block FROM (SELECT *, 'within:state,year(ngrams-reverse:conm=assignee)' AS b FROM y UNION ALL SELECT *, 'within:state,year(ngrams:conm=assignee)' FROM x) GROUP BY 1, 2""",
    "completeness": _with("s", "t") + "SELECT round(avg(CASE WHEN s.left_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS pairs_completeness FROM (SELECT DISTINCT * FROM t) t LEFT JOIN s USING (left_id, right_id)",
    "completeness_unordered": _with("dc", "c") + "SELECT round(avg(CASE WHEN d.left_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS pairs_completeness FROM (SELECT DISTINCT x.id AS left_id, y.id AS right_id FROM c x JOIN c y USING (cluster_id) WHERE x.id < y.id) k LEFT JOIN (SELECT DISTINCT left_id, right_id FROM dc) d USING (left_id, right_id)",
    "union_of_tables": """WITH e AS (SELECT left_id, right_id, block, max(sim) AS sim, 0 AS t FROM result_links GROUP BY 1, 2, 3 UNION ALL SELECT left_id, right_id, block, max(sim), 1 FROM result_scores GROUP BY 1, 2, 3),
      n AS (SELECT left_id, right_id, t, block, generate_subscripts(string_split(block, '+'), 1) AS i, unnest(string_split(block, '+')) AS name FROM e), o AS (SELECT left_id, right_id, name, min((t, block, i)) AS first FROM n GROUP BY 1, 2, 3)
      SELECT left_id, right_id, string_agg(name, '+' ORDER BY first) AS block, any_value(sim) AS sim FROM o JOIN (SELECT left_id, right_id, round(arg_min(sim, t), 6) AS sim FROM e GROUP BY 1, 2) USING (left_id, right_id) GROUP BY 1, 2""",
    "unproposed_records": f"SELECT 'left' AS side, gvkey AS id FROM {_F} WHERE gvkey NOT IN (SELECT left_id FROM result_scores) UNION ALL SELECT 'right', assignee_id FROM {_A} WHERE assignee_id NOT IN (SELECT right_id FROM result_scores)",
    "pairs_of_linked_firms": "SELECT DISTINCT left_id, right_id FROM result_scores WHERE left_id IN (SELECT left_id FROM result_links)",
    "judge_exact_shortcut": _with("s", "f", "a") + rf"SELECT left_id, right_id, CASE WHEN same THEN 1.0 ELSE max(CASE WHEN NOT same THEN sim END) OVER (PARTITION BY q) END AS p, CASE WHEN same THEN 'exact' ELSE 'jev' END AS source FROM (SELECT s.*, {norm('x.conm')} <> '' AND {norm('x.state')} <> '' AND {norm('x.conm')} = {norm('y.assignee')} AND {norm('x.state')} = {norm('y.state')} AS same, struct_pack(a := nullif(regexp_replace(conm, '^\s+|\s+$', '', 'g'), ''), b := nullif(regexp_replace(x.state, '^\s+|\s+$', '', 'g'), ''), c := nullif(regexp_replace(assignee, '^\s+|\s+$', '', 'g'), ''), d := nullif(regexp_replace(y.state, '^\s+|\s+$', '', 'g'), '')) AS q FROM s JOIN f x ON x.gvkey = left_id JOIN a y ON y.assignee_id = right_id)",
    "judge_budget": _with("s").rstrip() + rf""", st AS (SELECT s.*, struct_pack(a := nullif(regexp_replace(conm, '^\s+|\s+$', '', 'g'), ''), b := nullif(regexp_replace(x.state, '^\s+|\s+$', '', 'g'), ''), c := nullif(regexp_replace(assignee, '^\s+|\s+$', '', 'g'), ''), d := nullif(regexp_replace(y.state, '^\s+|\s+$', '', 'g'), '')) AS q FROM s JOIN {_F} x ON gvkey = left_id JOIN {_A} y ON assignee_id = right_id),
      k AS (SELECT q, row_number() OVER (ORDER BY max(sim) DESC, min((left_id, right_id))) AS k FROM st GROUP BY q) SELECT CASE WHEN k <= 2500 THEN 'jev' ELSE 'unjudged' END AS source, count(*) AS pairs, min(CASE WHEN k <= 2500 THEN sim END) AS least_sim FROM st JOIN k ON st.q IS NOT DISTINCT FROM k.q GROUP BY 1""",
    "judge_shared_states": _with("s").rstrip() + rf""", st AS (SELECT s.*, struct_pack(a := nullif(regexp_replace(conm, '^\s+|\s+$', '', 'g'), ''), b := nullif(regexp_replace(x.state, '^\s+|\s+$', '', 'g'), ''), c := nullif(regexp_replace(assignee, '^\s+|\s+$', '', 'g'), ''), d := nullif(regexp_replace(y.state, '^\s+|\s+$', '', 'g'), '')) AS q FROM s JOIN {_F} x ON gvkey = left_id JOIN {_A} y ON assignee_id = right_id)
      SELECT CASE WHEN row_number() OVER (PARTITION BY q ORDER BY left_id, right_id) = 1 THEN 'api' ELSE 'shared' END AS score_origin, 1 AS one FROM st""",
    "resume_todo": "SELECT source, count(*) AS pairs FROM result_scores WHERE source IN ('unjudged', 'error') GROUP BY 1",
    "margins": _with("mg") + "SELECT left_id, right_id, margin FROM mg",
    "resolve_many_to_many": _with("mg") + "SELECT left_id, right_id, p, margin FROM mg WHERE p >= 0.5",
    "resolve_many_to_one": _with("mg") + "SELECT left_id, right_id, p, margin FROM mg WHERE p >= 0.5 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY p DESC, sim DESC, right_id) = 1",
    "resolve_one_to_many": _with("mg") + "SELECT left_id, right_id, p, margin FROM mg WHERE p >= 0.5 QUALIFY row_number() OVER (PARTITION BY right_id ORDER BY p DESC, sim DESC, left_id) = 1",
    "resolve_min_margin": _with("mg") + "SELECT left_id, right_id, p, margin FROM (SELECT * FROM mg WHERE p >= 0.5 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY p DESC, sim DESC, right_id) = 1) WHERE margin IS NULL OR margin >= 0.1",
    "cluster_components": _with("selfs").rstrip() + ",\n" + _SELF_COMP + " SELECT id, dense_rank() OVER (ORDER BY first) - 1 AS cluster_id, count(*) OVER (PARTITION BY first) AS cluster_size FROM comp",
    "components_orders": """WITH RECURSIVE e AS (SELECT DISTINCT 'o' || l_orderkey AS o, 's' || l_suppkey AS s FROM lineitem), sup AS (SELECT DISTINCT x.s AS a, y.s AS b FROM e x JOIN e y USING (o)),
      r AS (SELECT DISTINCT a AS n, a AS m FROM sup UNION SELECT r.n, sup.b FROM r JOIN sup ON r.m = sup.a), c AS (SELECT n, min(m) AS k FROM r GROUP BY 1),
      nodes AS (SELECT s AS node, k FROM (SELECT DISTINCT s FROM e) JOIN c ON n = s UNION ALL SELECT o, min(k) FROM e JOIN c ON n = s GROUP BY o), g AS (SELECT k, count(*) AS nodes, min(node) AS component FROM nodes GROUP BY k) SELECT component, nodes FROM g""",
    "dedupe_links": _with("selfs", "c") + "SELECT left_id, right_id, p, x.cluster_id FROM selfs JOIN c x ON x.id = left_id JOIN c y ON y.id = right_id WHERE x.cluster_id = y.cluster_id",
    "dedupe_split_pairs": _with("selfs", "c") + "SELECT left_id, right_id, x.cluster_id AS left_cluster, y.cluster_id AS right_cluster FROM selfs JOIN c x ON x.id = left_id JOIN c y ON y.id = right_id WHERE x.cluster_id <> y.cluster_id AND p >= 0.5",
    "dedupe_labeled": _with("c") + f"SELECT assignee_id, cluster_id, cluster_size FROM {_A} LEFT JOIN c ON id = assignee_id",
    "audit_sample": _with("labels").rstrip() + """, sz AS (SELECT bin, count(*) AS n FROM labels GROUP BY 1), h AS (SELECT l.*, n, count(*) OVER () AS total, row_number() OVER (PARTITION BY bin ORDER BY md5('7|' || left_id || '|' || right_id), left_id, right_id) AS k FROM labels l JOIN sz USING (bin)),
      o AS (SELECT bin, n, row_number() OVER (ORDER BY list_position(['[0, 0.05]', '(0.05, 0.2]', '(0.2, 0.5]', '(0.5, 0.8]', '(0.8, 0.95]', '(0.95, 1]'], bin)) AS i FROM sz),
      al AS (SELECT 0 AS step, list(n ORDER BY i) AS size, list_transform(list(n ORDER BY i), lambda x: CAST(0 AS BIGINT)) AS got, least(200, sum(n)) AS remaining FROM o
        UNION ALL SELECT step + 1, size, list_transform(size, lambda x, j: got[j] + least(size[j] - got[j], CASE WHEN got[j] < size[j] THEN remaining // len(list_filter(size, lambda y, m: got[m] < size[m])) + CASE WHEN len(list_filter(size[1:j], lambda y, m: got[m] < size[m])) <= remaining % len(list_filter(size, lambda y, m: got[m] < size[m])) THEN 1 ELSE 0 END ELSE 0 END)),
          remaining - list_sum(list_transform(size, lambda x, j: least(size[j] - got[j], CASE WHEN got[j] < size[j] THEN remaining // len(list_filter(size, lambda y, m: got[m] < size[m])) + CASE WHEN len(list_filter(size[1:j], lambda y, m: got[m] < size[m])) <= remaining % len(list_filter(size, lambda y, m: got[m] < size[m])) THEN 1 ELSE 0 END ELSE 0 END))) FROM al WHERE remaining > 0),
      fin AS (SELECT got FROM al ORDER BY step DESC LIMIT 1) SELECT left_id, right_id, p, sel AS selected, h.bin, round(h.n / got[i], 9) AS weight FROM h JOIN o USING (bin) CROSS JOIN fin WHERE k <= got[i]""",
    "audit_fields": _with("l") + f"SELECT left_id, right_id, conm AS a_conm, assignee AS b_conm, x.state AS a_state, y.state AS b_state, x.year AS a_year FROM l JOIN {_F} x ON gvkey = left_id JOIN {_A} y ON assignee_id = right_id",
    "evaluate_threshold": _metrics("p >= 0.5"),
    "evaluate_selected": _metrics("sel"),
    "calibration_table": _with("lw") + "SELECT bin, count(*) FILTER (y IS NOT NULL) AS n, round(sum(w * p) FILTER (y IS NOT NULL) / sum(w) FILTER (y IS NOT NULL), 6) AS mean_p, round(sum(w * y) / sum(w) FILTER (y IS NOT NULL), 6) AS match_rate FROM lw GROUP BY 1",
    "score_against_truth": _with("l", "t", "s").rstrip() + """, u AS (SELECT DISTINCT * FROM t), g AS (SELECT (SELECT count(*) FROM l JOIN u USING (left_id, right_id)) AS tp, (SELECT count(*) FROM l) AS nl, (SELECT count(*) FROM u) AS nt, (SELECT count(*) FROM u JOIN s USING (left_id, right_id)) AS nf)
      SELECT tp, nl - tp AS fp, nt - tp AS fn, round(CASE WHEN nl > 0 THEN tp / nl END, 6) AS precision, round(CASE WHEN nt > 0 THEN tp / nt END, 6) AS recall, round(CASE WHEN nl + nt > 0 THEN 2 * tp / (nl + nt) END, 6) AS f1, round(CASE WHEN nt > 0 THEN nf / nt END, 6) AS pairs_completeness FROM g""",
    "stage_metrics": _with("l", "t", "s").rstrip() + """, u AS (SELECT DISTINCT * FROM t), g AS (SELECT (SELECT count(*) FROM u) AS truth, (SELECT count(*) FROM s) AS candidates, (SELECT count(*) FROM l) AS links, (SELECT count(*) FROM u JOIN s USING (left_id, right_id)) AS pr, (SELECT count(*) FROM u JOIN l USING (left_id, right_id)) AS fo)
      SELECT truth, candidates, links, round(CASE WHEN truth > 0 THEN pr / truth END, 6) AS blocking_recall, round(CASE WHEN pr > 0 THEN fo / pr END, 6) AS conditional_recall, round(CASE WHEN truth > 0 THEN fo / truth END, 6) AS final_recall, round(CASE WHEN links > 0 THEN fo / links END, 6) AS precision FROM g""",
    "recall_by_source": _with("s", "t") + "SELECT block, count(*) AS pairs, count(u.left_id) AS true_pairs FROM s LEFT JOIN (SELECT DISTINCT * FROM t) u USING (left_id, right_id) GROUP BY 1",
    "diagnose_errors": _with("s", "t", "l") + "SELECT CASE WHEN u.k IS NOT NULL AND s.p IS NULL AND NOT EXISTS (SELECT 1 FROM s z WHERE z.left_id = x.left_id AND z.right_id = x.right_id) THEN 'retrieval_miss' WHEN u.k IS NOT NULL AND m.k IS NULL THEN 'false_negative' ELSE 'false_positive' END AS kind, x.left_id, x.right_id FROM (SELECT left_id, right_id FROM t UNION SELECT left_id, right_id FROM l) x LEFT JOIN (SELECT DISTINCT *, 1 AS k FROM t) u USING (left_id, right_id) LEFT JOIN (SELECT *, 1 AS k FROM l) m USING (left_id, right_id) LEFT JOIN s USING (left_id, right_id) WHERE (u.k IS NOT NULL AND (m.k IS NULL OR NOT EXISTS (SELECT 1 FROM s z WHERE z.left_id = x.left_id AND z.right_id = x.right_id))) OR (u.k IS NULL AND m.k IS NOT NULL)",
    "baseline_exact": f"SELECT gvkey AS left_id, assignee_id AS right_id, 1.0 AS sim FROM (SELECT gvkey, {norm('conm')} AS n FROM {_F}) JOIN (SELECT assignee_id, {norm('assignee')} AS n FROM {_A}) USING (n) WHERE n <> ''",
    "baseline_jaro_winkler": f"SELECT left_id, right_id, round(sim, 6) AS sim FROM (SELECT gvkey AS left_id, assignee_id AS right_id, round({jw('x.n', 'y.n')}, 12) AS sim FROM (SELECT gvkey, {norm('conm')} AS n FROM {_F}) x JOIN (SELECT assignee_id, {norm('assignee')} AS n FROM {_A}) y ON x.n[1] = y.n[1] WHERE x.n <> '' AND y.n <> '') QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY sim DESC, right_id) = 1",
    "baseline_tfidf": _with("tw_cos", "f", "a") + f"SELECT l.gvkey AS left_id, r.assignee_id AS right_id, round(c.sim, 6) AS sim FROM tw_cos c JOIN f l ON {_LN} = c.lt JOIN a r ON {_RN} = c.rt QUALIFY row_number() OVER (PARTITION BY l.gvkey ORDER BY c.sim DESC, r.assignee_id) = 1",
    "tune_threshold": _with("s", "t").rstrip() + """, u AS (SELECT DISTINCT * FROM t), g AS (SELECT sim, count(*) AS n, count(u.left_id) AS good FROM s LEFT JOIN u USING (left_id, right_id) GROUP BY 1), r AS (SELECT sim, sum(n) OVER o AS links, sum(good) OVER o AS tp, (SELECT count(*) FROM u) AS nt FROM g WINDOW o AS (ORDER BY sim DESC))
      SELECT sim AS threshold, CAST(links AS BIGINT) AS links, CAST(tp AS BIGINT) AS tp, round(tp / links, 6) AS precision, round(tp / nt, 6) AS recall, round(2 * tp / (links + nt), 6) AS f1 FROM r ORDER BY 2 * tp / (links + nt) DESC, links LIMIT 1""",
    "threshold_sweep": _with("s", "t").rstrip() + """, u AS (SELECT DISTINCT * FROM t), b AS (SELECT * FROM s WHERE p >= 0 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY p DESC, sim DESC, right_id) = 1), g AS (SELECT round(0.05 * range, 2) AS threshold FROM range(21)), c AS (SELECT threshold, count(b.left_id) AS links, count(u.left_id) AS tp FROM g LEFT JOIN b ON b.p >= threshold LEFT JOIN u USING (left_id, right_id) GROUP BY 1)
      SELECT threshold, links, tp, round(CASE WHEN links > 0 THEN tp / links END, 6) AS precision, round(CASE WHEN nt > 0 THEN tp / nt END, 6) AS recall, round(CASE WHEN links + nt > 0 THEN 2 * tp / (links + nt) END, 6) AS f1 FROM c, (SELECT count(*) AS nt FROM u)""",
    "string_scores": _with("s") + f"SELECT left_id, right_id, CASE WHEN {norm('conm')} <> '' AND {norm('conm')} = {norm('assignee')} THEN 1.0 ELSE 0.0 END AS p FROM s JOIN {_F} ON gvkey = left_id JOIN {_A} ON assignee_id = right_id",
    "ecm_patterns": _with("s") + "SELECT g0, g1, g2, count(*) AS n FROM (SELECT " + ", ".join(f"CASE WHEN {x} <> '' AND {y} <> '' AND {jw(x, y)} >= 0.9 THEN 1 ELSE 0 END AS g{i}" for i, (x, y) in enumerate(((norm("conm"), norm("assignee")), (norm("x.state"), norm("y.state")), (norm("x.city"), norm("y.city"))))) + f" FROM s JOIN {_F} x ON gvkey = left_id JOIN {_A} y ON assignee_id = right_id) GROUP BY 1, 2, 3",
    "entity_split": _with("t").rstrip() + ",\n" + _SPLIT_EDGES + " SELECT side, id, CASE WHEN k <= floor(0.3 * n) THEN 'dev' ELSE 'test' END AS part FROM recs JOIN comp USING (node) JOIN rk USING (component)",
    "unmatched_right": _with("t").rstrip() + f", k AS (SELECT right_id, row_number() OVER (ORDER BY md5('0|' || left_id || '|' || right_id), left_id, right_id) AS k, floor(count(*) OVER () * 0.25) AS m FROM (SELECT DISTINCT * FROM t)) SELECT assignee_id FROM {_A} WHERE assignee_id NOT IN (SELECT right_id FROM k WHERE k <= m)",
    "canonical_names": _with("c").rstrip() + f", n AS (SELECT cluster_id, assignee AS s, count(*) AS k FROM {_A} JOIN c ON id = assignee_id WHERE assignee IS NOT NULL GROUP BY 1, 2) SELECT cluster_id, arg_min(s, (-k, s)) AS canonical, string_agg(s, ' | ' ORDER BY s) AS aliases FROM n GROUP BY 1",
    "judge_agreement": """WITH j AS (SELECT left_id, right_id, max(p) FILTER (model = 'small-a' AND NOT isnan(p)) AS pa, max(p) FILTER (model = 'small-b' AND NOT isnan(p)) AS pb FROM result_scores GROUP BY 1, 2), m AS (SELECT *, pa >= 0.5 AS ya, pb >= 0.5 AS yb FROM j WHERE pa IS NOT NULL AND pb IS NOT NULL),
      r AS (SELECT *, rank() OVER (ORDER BY pa) + (count(*) OVER (PARTITION BY pa) - 1) / 2 AS ra, rank() OVER (ORDER BY pb) + (count(*) OVER (PARTITION BY pb) - 1) / 2 AS rb FROM m), g AS (SELECT count(*) FILTER (ya AND yb) AS both_yes, count(*) FILTER (ya AND NOT yb) AS only_a, count(*) FILTER (yb AND NOT ya) AS only_b, count(*) FILTER (NOT ya AND NOT yb) AS both_no, count(*) AS n, corr(ra, rb) AS sp FROM r),
      k AS (SELECT *, (both_yes + both_no) / n AS ag, ((both_yes + only_a) * (both_yes + only_b) + (both_no + only_a) * (both_no + only_b)) / (n * n) AS ch FROM g) SELECT both_yes, only_a, only_b, both_no, CASE WHEN n > 0 THEN round(ag, 6) END AS agreement, round(CASE WHEN ch < 1 THEN (ag - ch) / (1 - ch) END, 6) AS kappa, CASE WHEN isfinite(sp) THEN round(sp, 6) END AS spearman FROM k""",
    "mixed_labels": _with("pt") + "SELECT lt, rt, count(*) AS n, sum(y) AS yes FROM pt GROUP BY 1, 2 HAVING sum(y) > 0 AND sum(y) < count(*)",
    "text_ceiling": _with("pt") + "SELECT CAST(sum(greatest(yes, n - yes)) AS BIGINT) AS ceiling, CAST(sum(n) AS BIGINT) AS pairs FROM (SELECT lt, rt, count(*) AS n, sum(y) AS yes FROM pt GROUP BY 1, 2)",
    "hardest_negatives": _with("s", "t") + "SELECT left_id, right_id, row_number() OVER (PARTITION BY left_id ORDER BY sim DESC, right_id) AS rank FROM s WHERE left_id IN (SELECT left_id FROM t) AND NOT EXISTS (SELECT 1 FROM t WHERE t.left_id = s.left_id AND t.right_id = s.right_id) QUALIFY rank <= 3",
    "equal_links": _with("s") + "SELECT left_id, right_id, p FROM (SELECT * FROM s WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY p DESC, right_id) = 1) ORDER BY p DESC, left_id, right_id LIMIT 300",
    "pair_classification": _with("pt").rstrip() + ", g AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM pt) SELECT tp, fp, fn, 0 AS unjudged, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM g",
    "merged_links": _with("m1") + f"SELECT left_id, right_id, p, conm, x.state AS state_left, x.city AS city_left, x.year AS year_left, assignee, y.state AS state_right, y.city AS city_right, y.year AS year_right FROM m1 JOIN {_F} x ON gvkey = left_id JOIN {_A} y ON assignee_id = right_id WHERE k = 1",
    "report_counts": "SELECT source, block, count(*) AS pairs, count(DISTINCT left_id) AS lefts, round(median(CASE WHEN NOT isnan(p) THEN p END), 6) AS median_p FROM result_scores GROUP BY 1, 2",
    "meter_totals": "SELECT model, provider, score_origin, count(*) AS answers FROM result_scores GROUP BY 1, 2, 3",
    "review_apply": _with("s", "l", "dec").rstrip() + """, x AS (SELECT s.*, decision FROM s LEFT JOIN dec USING (left_id, right_id)), rest AS (SELECT * FROM x WHERE decision IS NULL AND left_id NOT IN (SELECT left_id FROM dec WHERE decision = 'accept')),
      o AS (SELECT left_id, right_id, p, 'manual_accept' AS selection_basis, 'accept' AS review_decision FROM x WHERE decision = 'accept' UNION ALL SELECT left_id, right_id, p, 'automatic', '' FROM (SELECT * FROM rest WHERE p >= 0.5 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY p DESC, sim DESC, right_id) = 1))
      SELECT o.*, l.left_id IS NOT NULL AS original_selected FROM o LEFT JOIN l USING (left_id, right_id)""",
    "review_latest": _with("dec") + "SELECT left_id, right_id, CASE WHEN md5(left_id || '|' || right_id)[1] < '8' THEN 'unsure' ELSE decision END AS decision FROM dec",
    "review_queue_left": _with("s", "l").rstrip() + f""", r AS (SELECT left_id AS id, p, row_number() OVER (PARTITION BY left_id ORDER BY p DESC NULLS LAST) AS k FROM s), g AS (SELECT id, count(*) AS candidates, round(max(p) FILTER (k = 1) - max(p) FILTER (k = 2), 6) AS gap, count(*) FILTER (p IS NULL) > 0 AS unjudged FROM r GROUP BY 1),
      q AS (SELECT gvkey AS id, coalesce(candidates, 0) AS candidates, gap, gvkey NOT IN (SELECT left_id FROM l) AS unmatched, coalesce(unjudged, false) AS unjudged, coalesce(gap <= 0.1, false) AS close FROM {_F} LEFT JOIN g ON g.id = gvkey) SELECT *, CASE WHEN close THEN 0 WHEN unmatched THEN 1 WHEN unjudged THEN 2 ELSE 3 END AS priority FROM q""",
}
SQL["judge_shared_states"] = SQL["judge_shared_states"].replace("SELECT CASE WHEN row_number()", "SELECT score_origin, count(*) AS pairs FROM (SELECT CASE WHEN row_number()").replace(" AS score_origin, 1 AS one FROM st", " AS score_origin FROM st) GROUP BY 1")
SQL["choose_threshold"] = SQL["threshold_sweep"] + " ORDER BY coalesce(CASE WHEN links + nt > 0 THEN 2 * tp / (links + nt) END, -1) DESC, links, threshold LIMIT 1"
SQL["review_selected"] = _with("s", "l") + "SELECT l.left_id IS NOT NULL AS selected, count(*) AS pairs, max(p) AS best_p FROM s LEFT JOIN l USING (left_id, right_id) GROUP BY 1"
SQL["aligned_ids"] = "SELECT DISTINCT left_id, right_id FROM result_links"
SQL["link_firms"] = (
    _with("f", "a", "tc_unit").rstrip() + ",\n" + _UNION3 + ",\n" + _UNION_SIM
    + """, g AS (SELECT *, greatest((SELECT max(b.sim) FROM u4 b WHERE b.left_id = u4.left_id AND b.right_id <> u4.right_id), (SELECT max(b.sim) FROM u4 b WHERE b.right_id = u4.right_id AND b.left_id <> u4.left_id)) AS rival FROM u4)
      SELECT left_id, right_id, block, round(sim, 6) AS sim, round(sim, 6) AS p, round(sim - rival, 6) AS margin FROM g WHERE sim >= 0.5 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY sim DESC, right_id) = 1"""
)
