"""Header mapping; every customer stands for one file with its own header."""

from __future__ import annotations

from pyspark.sql import functions as F

from csvharbor.operators import mapping
from csvharbor.workload.base import query, table

EXPECTED = ("account_id", "account_name", "last_activity", "type")
# Header of a file by customer key; ``#`` stands for the customer's nation.
SHAPES = (
    ("Account ID", "account_name", " LAST_ACTIVITY", "Type"),
    ("name", "the account id", "last activity date", "kind"),
    ("acount_id", "acct_name", "last_activty", "typ#"),
    ("type", "TYPE", "account_id", "x", "account id"),
    ("foo", "bar#"),
    ("account_id", "account_name", "last_activity", "type"),
    ("Account_ID ", "Account_Name", "region", "Type", "nation #"),
)
TEMPLATES = (
    ("account_id", "account_name", "last_activity", "type"),
    ("Account ID", "account_name", "last_activity", "type"),
    ("account_id", "account_name", "type"),
    ("foo", "bar1", "bar2"),
    ("Type", "account_name", "region", "account_id", "nation 3"),
)


def shape_sql(shapes, number: str, mark: str) -> str:
    def cell(h: str) -> str:
        return " || ".join(f"'{part}'" if i == 0 else f"{mark} || '{part}'" for i, part in enumerate(h.split("#")))

    arms = " ".join(f"WHEN {i} THEN [{', '.join(cell(h) for h in shape)}]" for i, shape in enumerate(shapes))
    return f"CASE {number} % {len(shapes)} {arms} END"


def shape(shapes, number, mark):
    chosen = F.when(F.lit(False), F.array().cast("array<string>"))
    for i, names in enumerate(shapes):
        chosen = chosen.when(number % len(shapes) == i, F.array(*[F.replace(F.lit(h), F.lit("#"), mark.cast("string")) for h in names]))
    return chosen


FILES_SQL = f"SELECT 'crm' AS table_key, CAST(c_custkey AS VARCHAR) AS file, {shape_sql(SHAPES, 'c_custkey', 'CAST(c_nationkey AS VARCHAR)')} AS headers FROM customer"
TEMPLATES_SQL = f"""
    SELECT 't' || CAST(n_nationkey AS VARCHAR) AS template_id, CASE WHEN n_nationkey % 4 = 3 THEN 'erp' ELSE 'crm' END AS table_key,
           {shape_sql(TEMPLATES, 'n_nationkey', "''")} AS csv_headers FROM nation"""
OVERLAP_SQL = """len(list_filter(list_transform(t.csv_headers, lambda h: lower(trim(h))), lambda h: list_contains(list_transform(f.headers, lambda x: lower(trim(x))), h)))
    / len(t.csv_headers)"""


def files(spark, sf):
    cells = table(spark, sf, "customer").select(
        F.lit("crm").alias("table_key"),
        F.col("c_custkey").cast("string").alias("file"),
        F.posexplode(shape(SHAPES, F.col("c_custkey"), F.col("c_nationkey"))).alias("position", "name"),
    )
    return mapping.file_headers(cells)


def templates(spark, sf):
    key = F.col("n_nationkey")
    at = F.map_from_entries(F.array(*[F.struct(F.lit(e), (key % 3 + i).cast("int")) for i, e in enumerate(EXPECTED[:3])]))
    return table(spark, sf, "nation").select(
        F.concat(F.lit("t"), key.cast("string")).alias("template_id"),
        F.when(key % 4 == 3, "erp").otherwise("crm").alias("table_key"),
        shape(TEMPLATES, key, F.lit("")).alias("csv_headers"),
        at.alias("column_mapping"),
    )


@query(f"""
    SELECT * FROM (SELECT f.table_key, f.file, t.template_id, {OVERLAP_SQL} AS score FROM ({FILES_SQL}) f JOIN ({TEMPLATES_SQL}) t USING (table_key))
    WHERE score >= 0.7""")
def template_match(spark, sf):
    return mapping.match_templates(files(spark, sf), templates(spark, sf))


def norm(name: str) -> str:
    return f"regexp_replace(lower({name}), '[_\\s]+', '', 'g')"


SCORED_SQL = f"""
    SELECT table_key, file, e.expected, e.expected_no, position,
           CASE WHEN want = have THEN 0 WHEN contains(have, want) OR contains(want, have) THEN abs(length(have) - length(want)) * 0.5
                ELSE levenshtein(want, have) / greatest(length(want), length(have)) * 10 END AS score,
           CASE WHEN want = have THEN -position ELSE position END AS tie
    FROM (SELECT table_key, file, unnest(headers) AS header, generate_subscripts(headers, 1) - 1 AS position FROM ({FILES_SQL})) f,
         (VALUES {', '.join(f"('{e}', {i})" for i, e in enumerate(EXPECTED))}) e(expected, expected_no),
         LATERAL (SELECT {norm('e.expected')} AS want, {norm('f.header')} AS have) n"""
BEST_SQL = f"""
    SELECT table_key, file, expected, expected_no, CAST(CASE WHEN score <= 5 THEN position ELSE -1 END AS INTEGER) AS position FROM
      (SELECT *, row_number() OVER (PARTITION BY file, expected ORDER BY score, tie) AS rn FROM ({SCORED_SQL})) WHERE rn = 1"""
AUTO_SQL = f"""
    SELECT table_key, file, expected, expected_no,
           CASE WHEN position >= 0 AND row_number() OVER (PARTITION BY file, position ORDER BY expected_no) = 1 THEN position ELSE -1 END AS position
    FROM ({BEST_SQL})"""


@query(BEST_SQL)
def suggest_mapping(spark, sf):
    return mapping.suggest_mapping(files(spark, sf), EXPECTED)


@query(AUTO_SQL)
def auto_mapping(spark, sf):
    return mapping.auto_mapping(files(spark, sf), EXPECTED)


@query(f"""
    WITH best AS (SELECT * FROM (SELECT f.table_key, f.file, t.template_id, row_number() OVER (PARTITION BY f.file ORDER BY {OVERLAP_SQL} DESC, t.template_id DESC) AS rn
                  FROM ({FILES_SQL}) f JOIN ({TEMPLATES_SQL}) t USING (table_key) WHERE {OVERLAP_SQL} >= 0.9) WHERE rn = 1)
    SELECT a.table_key, a.file, b.template_id, a.expected, a.expected_no,
           CAST(CASE WHEN b.template_id IS NULL THEN a.position WHEN a.expected_no < 3 THEN CAST(substr(b.template_id, 2) AS INTEGER) % 3 + a.expected_no ELSE -1 END AS INTEGER) AS position
    FROM ({AUTO_SQL}) a LEFT JOIN best b USING (file)""")
def initial_mapping(spark, sf):
    return mapping.initial_mapping(files(spark, sf), templates(spark, sf), EXPECTED)


@query(f"SELECT file, list_transform(headers, lambda h: lower(h)) = {list(EXPECTED)} AS same FROM ({FILES_SQL})")
def headers_equal(spark, sf):
    return files(spark, sf).select("file", mapping.headers_equal(F.col("headers"), EXPECTED).alias("same"))


@query(f"SELECT f.file, t.template_id, {OVERLAP_SQL} AS score FROM ({FILES_SQL}) f JOIN ({TEMPLATES_SQL}) t ON t.template_id = 't' || CAST(CAST(f.file AS BIGINT) % 25 AS VARCHAR)")
def header_overlap(spark, sf):
    mine = F.concat(F.lit("t"), (F.col("file").cast("long") % 25).cast("string"))
    joined = files(spark, sf).withColumn("template_id", mine).join(templates(spark, sf).drop("table_key"), "template_id")
    return joined.select("file", "template_id", mapping.overlap(F.col("csv_headers"), F.col("headers")).alias("score"))
