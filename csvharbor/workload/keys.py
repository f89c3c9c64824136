"""Key lookups, duplicates, and the classification of incoming rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from csvharbor.functions import formats
from csvharbor.operators import joins
from csvharbor.plans import preview
from csvharbor.workload.base import CUSTOMER, query, table

PAIR = ["l_orderkey", "l_linenumber"]


@query("SELECT DISTINCT c_custkey FROM (SELECT c_custkey * 2 AS c_custkey FROM customer) WHERE c_custkey IN (SELECT c_custkey FROM customer)")
def existing_keys_single(spark, sf):
    customers = table(spark, sf, "customer")
    asked = customers.select((F.col("c_custkey") * 2).alias("c_custkey"))
    return joins.existing_keys(asked, customers, ["c_custkey"])


@query("""
    SELECT DISTINCT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber + 3 AS l_linenumber FROM lineitem) a
    WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber)""")
def existing_keys_composite(spark, sf):
    lines = table(spark, sf, "lineitem")
    asked = lines.select("l_orderkey", (F.col("l_linenumber") + 3).alias("l_linenumber"))
    return joins.existing_keys(asked, lines, PAIR)


@query("""
    SELECT user_id, event_type, count(*) AS n_rows, min(event_id) AS first_line, max(event_id) AS last_line, count(*) - 1 AS extra
    FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def in_file_duplicates(spark, sf):
    return joins.duplicate_keys(table(spark, sf, "events"), ["user_id", "event_type"], "event_id")


@query("""
    SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER w AS n_rows, min(l_partkey) OVER w AS first_line,
                          l_partkey = min(l_partkey) OVER w AS is_first
                   FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber)) WHERE n_rows > 1""")
def duplicate_lines(spark, sf):
    return joins.duplicate_lines(table(spark, sf, "lineitem"), PAIR, "l_partkey")


@query("SELECT DISTINCT user_id, event_type FROM events")
def distinct_keys(spark, sf):
    return joins.distinct_keys(table(spark, sf, "events"), ["user_id", "event_type"])


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS row_key,
           CAST(l_orderkey AS VARCHAR) || '|' || l_returnflag AS replaced,
           CASE WHEN l_linenumber <> 3 THEN CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) END AS incoming_key,
           CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber AS VARCHAR) END AS second_part
    FROM lineitem""")
def composite_keys(spark, sf):
    lines = table(spark, sf, "lineitem")
    key = formats.display_key([F.col("l_orderkey"), F.col("l_linenumber")])
    second = F.when(F.col("l_linenumber") != 3, F.col("l_linenumber").cast("string")).otherwise("")
    incoming = formats.record_key([F.col("l_orderkey").cast("string"), second])
    broken = F.when(F.col("l_linenumber") != 3, key).otherwise(F.col("l_orderkey").cast("string"))
    return lines.select(
        *PAIR,
        "l_partkey",
        key.alias("row_key"),
        formats.replace_key_part(key, 2, 1, F.col("l_returnflag")).alias("replaced"),
        incoming.alias("incoming_key"),
        F.get(formats.split_key(broken, 2), F.lit(1)).alias("second_part"),
    )


NEW_KEYS = 1_000_000_000


def incoming_customers(spark, sf):
    """A third unchanged, a third with another balance, a third with new keys, some rows twice, some wrong."""
    c = table(spark, sf, "customer")
    key, rest = F.col("c_custkey"), F.col("c_custkey") % 3
    rows = c.select(
        key.alias("line_number"),
        F.when(rest == 2, key + NEW_KEYS).otherwise(key).alias("c_custkey"),
        "c_name",
        "c_nationkey",
        F.when(rest == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(key % 6 == 1, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(key % 17 == 0, F.array(F.lit("broken"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )
    again = rows.filter(F.col("line_number") % 11 == 0).withColumn("line_number", F.col("line_number") + 2 * NEW_KEYS)
    return rows.unionByName(again)


INCOMING_SQL = f"""
    SELECT c_custkey AS line_number, CASE WHEN c_custkey % 3 = 2 THEN c_custkey + {NEW_KEYS} ELSE c_custkey END AS c_custkey,
           c_name, c_nationkey, CASE WHEN c_custkey % 3 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_custkey % 6 <> 1 THEN c_mktsegment END AS c_mktsegment, c_custkey % 17 = 0 AS broken, c_custkey AS src
    FROM customer"""
INCOMING_SQL = f"""
    ({INCOMING_SQL} UNION ALL SELECT line_number + {2 * NEW_KEYS}, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, broken, src
     FROM ({INCOMING_SQL}) WHERE src % 11 = 0)"""
STATUS_SQL = "CASE WHEN broken THEN 'error' WHEN src % 3 = 2 THEN 'new' ELSE 'update' END"


@query(f"SELECT line_number, c_custkey, {STATUS_SQL} AS status FROM {INCOMING_SQL}")
def classify_rows(spark, sf):
    classified = preview.classify(incoming_customers(spark, sf), table(spark, sf, "customer"), ["c_custkey"])
    return classified.select("line_number", "c_custkey", "status")


@query(f"""
    SELECT count(*) AS total_rows, count(*) FILTER (WHERE status = 'new') AS new_rows, count(*) FILTER (WHERE status = 'update') AS update_rows,
           count(*) FILTER (WHERE status = 'error') AS error_rows,
           count(*) FILTER (WHERE status <> 'error') - count(DISTINCT c_custkey) FILTER (WHERE status <> 'error') AS duplicate_in_file
    FROM (SELECT *, {STATUS_SQL} AS status FROM {INCOMING_SQL})""")
def preview_summary(spark, sf):
    classified = preview.classify(incoming_customers(spark, sf), table(spark, sf, "customer"), ["c_custkey"])
    return preview.summary(classified, ["c_custkey"])


def updates(spark, sf):
    classified = preview.classify(incoming_customers(spark, sf), table(spark, sf, "customer"), ["c_custkey"])
    typed = F.struct(*[f.column for f in CUSTOMER.fields])
    return classified.filter("status = 'update'").withColumn("row", typed).withColumn("_key0", F.col("c_custkey"))


@query(f"""
    SELECT line_number, c_custkey,
           CASE WHEN src % 3 = 1 THEN 'c_acctbal' ELSE '' END || CASE WHEN src % 6 = 1 THEN ',c_mktsegment' ELSE '' END AS changed
    FROM {INCOMING_SQL} WHERE {STATUS_SQL} = 'update'""")
def update_diff(spark, sf):
    found = preview.diffs(updates(spark, sf), table(spark, sf, "customer"), CUSTOMER)
    return found.select("line_number", "c_custkey", F.array_join("changed", ",").alias("changed"))


@query(f"""
    SELECT line_number, c_custkey, CASE WHEN src % 3 = 1 THEN 'c_acctbal' ELSE '' END AS changed
    FROM {INCOMING_SQL} WHERE {STATUS_SQL} = 'update'""")
def update_diff_as_text(spark, sf):
    """Texts are compared; a column the file lacks (here the segment of some rows) is no difference."""
    shown = F.create_map(
        F.lit("c_acctbal"), formats.preview_number(F.col("c_acctbal")), F.lit("c_name"), F.col("c_name"),
        F.lit("c_nationkey"), F.col("c_nationkey").cast("string"),
    )
    found = preview.diffs(updates(spark, sf).withColumn("values", shown), table(spark, sf, "customer"), CUSTOMER, "text")
    return found.select("line_number", "c_custkey", F.array_join("changed", ",").alias("changed"))


def sample(status: str, n: int) -> None:
    @query(f"SELECT line_number, c_custkey FROM {INCOMING_SQL} WHERE {STATUS_SQL} = '{status}' ORDER BY line_number LIMIT {n}", f"sample_{status}_rows")
    def run(spark, sf):
        classified = preview.classify(incoming_customers(spark, sf), table(spark, sf, "customer"), ["c_custkey"])
        return classified.filter(F.col("status") == status).orderBy("line_number").limit(preview.SAMPLES[status]).select("line_number", "c_custkey")


sample("new", 10)
sample("update", 10)
sample("error", 20)
