"""Queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.groups import group_ids

    return group_ids(_read(spark, sf_dir, "result_scores"), "left_id", "right_id", "p", 0.5, _read(spark, sf_dir, "dedupe_clusters"), "id", "cluster_id")


def _firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.entities import profiles

    return profiles(_read(spark, sf_dir, "compustat_sample"), "c", "gvkey", "conm").unionByName(profiles(_read(spark, sf_dir, "patent_assignees"), "a", "assignee_id", "assignee"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.linkage import link
    from kindred.scratch import Scratch

    return link(_firms(spark, sf_dir), "c", "a", Scratch(spark, "linkage")).withColumnsRenamed({"left_id": "gvkey", "right_id": "assignee_id"})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_links(spark, sf_dir).select("gvkey", "assignee_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from kindred.llm.copies import copies, letters_digits, line_fields

    def table(name: str, key: str, label: str) -> DataFrame:
        fields = [letters_digits(F.col(c)) for c in (label, "state", "city", "year")]
        return copies(_read(spark, sf_dir, name), key, fields, where=fields[0] != "")

    lines = _read(spark, sf_dir, "record_lines")
    found = [table("compustat_sample", "gvkey", "conm"), table("patent_assignees", "assignee_id", "assignee"), copies(lines, "line_id", [line_fields(F.col("line"))], where=F.col("line").isNotNull())]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("row_id", "first_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.entities import same_entity, variants
    from kindred.scratch import Scratch

    return variants(same_entity(_firms(spark, sf_dir), Scratch(spark, "variants")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.topn import ranked_pairs, top_n

    scores = ranked_pairs(_read(spark, sf_dir, "result_scores"), "scores", "left_id", "right_id", 3)
    links = ranked_pairs(_read(spark, sf_dir, "result_links"), "links", "right_id", "left_id", 2)
    return top_n(scores.unionByName(links), ["list_name", "group_id"], "item_id", ["p", "sim"], "n")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.look import same_look

    return same_look(_read(spark, sf_dir, "compustat_sample"), "gvkey", "conm").unionByName(same_look(_read(spark, sf_dir, "patent_assignees"), "assignee_id", "assignee"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.tokens import encode

    return encode(_read(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.leaks import leaks

    return leaks(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.reading import reading_levels

    return reading_levels(_read(spark, sf_dir, "documents"), "doc_id", "text", "lang", _read(spark, sf_dir, "reading_labels"), "doc_id", "band", ["easy", "plain", "hard", "advanced"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).where("prose and level = 'advanced'").select("doc_id").distinct()


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit() and callable(v)}


P1_SQL = """
WITH RECURSIVE e AS (
  SELECT left_id AS a, right_id AS b FROM result_scores WHERE p >= 0.5 AND NOT isnan(p)
  UNION SELECT right_id, left_id FROM result_scores WHERE p >= 0.5 AND NOT isnan(p)
  UNION SELECT x.id, y.m FROM dedupe_clusters x JOIN (SELECT cluster_id, min(id) AS m FROM dedupe_clusters GROUP BY 1) y USING (cluster_id)
  UNION SELECT y.m, x.id FROM dedupe_clusters x JOIN (SELECT cluster_id, min(id) AS m FROM dedupe_clusters GROUP BY 1) y USING (cluster_id)
), ids AS (
  SELECT left_id AS id FROM result_scores UNION SELECT right_id FROM result_scores UNION SELECT id FROM dedupe_clusters
), r AS (
  SELECT id, id AS reach FROM ids UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a
)
SELECT id, min(reach) AS group_id FROM r WHERE id IS NOT NULL GROUP BY id
"""

P5_SQL = """
WITH s AS (
  SELECT 'scores' AS list_name, left_id AS group_id, right_id AS item_id, max(p) AS p, max(sim) AS sim, 3 AS n FROM result_scores
  WHERE p IS NOT NULL AND NOT isnan(p) GROUP BY left_id, right_id
  UNION ALL
  SELECT 'links', right_id, left_id, max(p), max(sim), 2 FROM result_links WHERE p IS NOT NULL AND NOT isnan(p) GROUP BY left_id, right_id
), r AS (SELECT *, row_number() OVER (PARTITION BY list_name, group_id ORDER BY p DESC, sim DESC, item_id) AS r FROM s)
SELECT list_name, group_id, item_id FROM r WHERE r <= n
"""

def _canon(x: str) -> str:
    return rf"replace(lower(upper(regexp_replace(CAST({x} AS VARCHAR), '[^\p{{L}}\p{{N}}]', '', 'g'))), 'ß', 'ss')"


def _table_rows(t: str, key: str, name: str) -> str:
    form = ", ".join(f"coalesce({_canon(c)}, chr(1))" for c in (name, "state", "city", "year"))
    return f"SELECT '{t}' AS t, {key} AS row_id, concat_ws(chr(31), {form}) AS form FROM {t} WHERE {_canon(name)} <> ''"


_LINES = rf"""
SELECT 'record_lines' AS t, line_id AS row_id, array_to_string(list_sort(list_filter(
  CASE WHEN ltrim(line) LIKE '{{%' THEN list_transform(map_entries(CAST(CAST(line AS JSON) AS MAP(VARCHAR, VARCHAR))), lambda e: {_canon("e.key")} || '=' || coalesce({_canon("e.value")}, ''))
  ELSE list_transform(list_filter(string_split_regex(' ' || line, '\sCOL\s+'), lambda x: trim(x) <> ''),
    lambda x: {_canon(r"regexp_extract(x, '^(\S+)\s+VAL', 1)")} || '=' || {_canon(r"regexp_extract(x, '(?s)^\S+\s+VAL(.*)$', 1)")}) END,
  lambda x: x NOT LIKE '%=')), chr(30)) AS form FROM record_lines WHERE line IS NOT NULL
"""
P3_SQL = (
    f"WITH r AS ({_table_rows('compustat_sample', 'gvkey', 'conm')} UNION ALL {_table_rows('patent_assignees', 'assignee_id', 'assignee')} UNION ALL {_LINES})"
    " SELECT row_id, first_id FROM (SELECT row_id, min(row_id) OVER w AS first_id, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY t, form)) WHERE n > 1"
)


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p3_found": P3_SQL, "p5_found": P5_SQL}
