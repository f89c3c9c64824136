"""Deletes, edits and resets driven by request tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from csvharbor.operators import audit, changes, joins
from csvharbor.workload.base import AS_OF_YEAR, CUSTOMER, LINEITEM, TABLES, double, query, table


def at():
    return F.lit("2026-06-01 12:00:00").cast("timestamp")


def doomed(spark, sf):
    """Keys to delete as text, among them unknown ones."""
    keys = table(spark, sf, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("row_key"))
    return keys.unionByName(keys.select(F.concat(F.lit("99"), "row_key", F.lit("0000000")).alias("row_key")))


@query("SELECT * FROM customer WHERE c_custkey % 5 = 0")
def point_lookups(spark, sf):
    customers = table(spark, sf, "customer")
    return changes.rows_of_keys(customers, changes.parse_keys(doomed(spark, sf), CUSTOMER, customers), CUSTOMER)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0")
def delete_keys_single(spark, sf):
    customers = table(spark, sf, "customer")
    keys = changes.parse_keys(doomed(spark, sf), CUSTOMER, customers)
    return changes.delete_rows(customers, keys, CUSTOMER).rows.select("c_custkey", "c_name", "c_acctbal")


@query("SELECT 'row_delete' AS action, 'high' AS severity, 'customer' AS table_key, CAST(c_custkey AS VARCHAR) AS row_key, c_name, 1 AS rows_affected FROM customer WHERE c_custkey % 5 = 0")
def delete_audit(spark, sf):
    customers = table(spark, sf, "customer")
    keys = changes.parse_keys(doomed(spark, sf), CUSTOMER, customers)
    entries = audit.delete_entries(changes.delete_rows(customers, keys, CUSTOMER).changes, at())
    return entries.select("action", "severity", "table_key", "row_key", F.get_json_object("row_data", "$.c_name").alias("c_name"), "rows_affected")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    WHERE NOT (l_linenumber = 2 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 3 = 0))""")
def delete_keys_composite(spark, sf):
    """Keys need not be unique in the table; texts with too few or too many parts are skipped."""
    lines = table(spark, sf, "lineitem")
    order = lines.filter("l_partkey % 3 = 0").select(F.col("l_orderkey").cast("string").alias("k"))
    keys = order.select(F.concat("k", F.lit("|2")).alias("row_key"))
    broken = order.select("k").unionByName(order.select(F.concat("k", F.lit("|1|1")).alias("k"))).withColumnRenamed("k", "row_key")
    parsed = changes.parse_keys(keys.unionByName(broken), LINEITEM, lines)
    return changes.delete_rows(lines, parsed, LINEITEM).rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def edits(spark, sf):
    """New balances, some unreadable, each after an older one under another spelling; cleared segments; unknown columns."""
    c = table(spark, sf, "customer")
    key, rest = F.col("c_custkey"), F.col("c_custkey") % 4
    balance = F.when(key % 16 == 0, "lots").otherwise(F.concat(F.lit("$"), key.cast("string"), F.lit(".25")))
    return (
        c.filter(rest == 0).select("c_custkey", F.lit("C_AcctBal").alias("column"), balance.alias("value"), F.lit(2).alias("at"))
        .unionByName(c.filter(rest == 0).select("c_custkey", F.lit("c_acctbal").alias("column"), F.lit("999999").alias("value"), F.lit(1).alias("at")))
        .unionByName(c.filter(key % 6 == 0).select("c_custkey", F.lit("c_mktsegment").alias("column"), F.lit("").alias("value"), F.lit(1).alias("at")))
        .unionByName(c.filter(rest == 3).select("c_custkey", F.lit("nothing").alias("column"), F.lit("x").alias("value"), F.lit(1).alias("at")))
    )


GOOD_EDIT = "c_custkey % 4 = 0 AND c_custkey % 16 <> 0"


@query(f"""
    SELECT c_custkey, c_name, CASE WHEN {GOOD_EDIT} THEN c_custkey + 0.25 ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS c_mktsegment
    FROM customer""")
def update_cell(spark, sf):
    out = changes.update_cells(table(spark, sf, "customer"), edits(spark, sf), CUSTOMER, AS_OF_YEAR, "at")
    return out.rows.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query(f"""
    SELECT CAST(c_custkey AS VARCHAR) AS row_key, 'c_acctbal' AS column_name,
           CASE WHEN c_acctbal = floor(c_acctbal) THEN printf('%.0f', c_acctbal) ELSE printf('%.2f', c_acctbal) END AS old_value,
           '$' || CAST(c_custkey AS VARCHAR) || '.25' AS new_value, 'cell_edit' AS action, 'medium' AS severity
    FROM customer WHERE {GOOD_EDIT}
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_mktsegment', c_mktsegment, NULL, 'cell_edit', 'medium' FROM customer WHERE c_custkey % 6 = 0""")
def update_cell_audit(spark, sf):
    out = changes.update_cells(table(spark, sf, "customer"), edits(spark, sf), CUSTOMER, AS_OF_YEAR, "at")
    return audit.edit_entries(out.changes, at()).select("row_key", "column_name", "old_value", "new_value", "action", "severity")


@query("""
    SELECT c_custkey, 'C_AcctBal' AS "column", 'invalid' AS status, 'invalid number format' AS reason FROM customer WHERE c_custkey % 16 = 0
    UNION ALL SELECT c_custkey, 'c_acctbal', 'superseded', 'replaced by a later edit of the same cell' FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT c_custkey, 'nothing', 'invalid', 'column not found: nothing' FROM customer WHERE c_custkey % 4 = 3""")
def rejected_edits(spark, sf):
    out = changes.update_cells(table(spark, sf, "customer"), edits(spark, sf), CUSTOMER, AS_OF_YEAR, "at")
    return out.rejected.select("c_custkey", "column", "status", "reason")


@query("""
    SELECT DISTINCT a.c_custkey, a.c_custkey * 3 AS wanted FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey * 3 WHERE a.c_custkey <> b.c_custkey""")
def key_collision(spark, sf):
    customers = table(spark, sf, "customer")
    moves = customers.select("c_custkey", F.col("c_custkey").alias("was"), (F.col("c_custkey") * 3).alias("wanted"))
    return joins.colliding_edits(moves, customers, ["was"], ["wanted"], ["c_custkey"]).select("c_custkey", "wanted")


def bulk(spark, sf):
    customers = table(spark, sf, "customer")
    keys = customers.filter("c_custkey % 3 = 0").select("c_custkey").unionByName(customers.select((-F.col("c_custkey") - 1).alias("c_custkey")))
    return changes.bulk_edit(customers, keys, "C_MktSegment", "BUILDING", CUSTOMER, AS_OF_YEAR)


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def bulk_edit(spark, sf):
    return bulk(spark, sf).rows.select("c_custkey", "c_name", "c_mktsegment")


@query("""
    SELECT 'cell_edit' AS action, CAST(c_custkey AS VARCHAR) AS row_key, c_mktsegment AS old_value, 'BUILDING' AS new_value, 1 AS rows_affected, CAST(NULL AS VARCHAR) AS reason
    FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING'
    UNION ALL SELECT 'bulk_edit', NULL, NULL, 'BUILDING', CAST(count(*) AS INTEGER), 'Bulk edited ' || CAST(count(*) AS VARCHAR) || ' rows' FROM customer WHERE c_custkey % 3 = 0""")
def bulk_edit_audit(spark, sf):
    out = bulk(spark, sf)
    entries = audit.edit_entries(out.changes, at()).unionByName(audit.bulk_edit_entries(out.summary, at()))
    return entries.select("action", "row_key", "old_value", "new_value", "rows_affected", "reason")


@query("SELECT -c_custkey - 1 AS c_custkey FROM customer")
def bulk_edit_unmatched(spark, sf):
    return bulk(spark, sf).unmatched


@query("SELECT 'table_reset' AS action, 'orders' AS table_key, CAST(count(*) AS INTEGER) AS rows_affected, 0 AS rows_left FROM orders")
def reset_table(spark, sf):
    change = changes.reset_table(table(spark, sf, "orders"), "orders")
    left = change.rows.agg(F.count("*").cast("int").alias("rows_left"))
    return audit.reset_entries(change.changes, at()).select("action", "table_key", "rows_affected").join(left)


@query(" UNION ALL ".join(f"SELECT 'table_reset' AS action, 'critical' AS severity, '{t}' AS table_key, CAST(count(*) AS INTEGER) AS rows_affected FROM {t}" for t in TABLES))
def reset_all_tables(spark, sf):
    counts = [c.changes for c in changes.reset_tables({t: table(spark, sf, t) for t in TABLES}).values()]
    entries = [audit.reset_entries(c, at()) for c in counts]
    joined = entries[0]
    for entry in entries[1:]:
        joined = joined.unionByName(entry)
    return joined.select("action", "severity", "table_key", "rows_affected")


@query("""
    SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 5 = 0""")
def restore_deleted(spark, sf):
    """Deleted rows back from the JSON that the audit log keeps."""
    customers = table(spark, sf, "customer")
    keys = changes.parse_keys(doomed(spark, sf), CUSTOMER, customers)
    kept = changes.delete_rows(customers, keys, CUSTOMER).changes
    return kept.select(F.from_json("row_data", customers.schema).alias("r")).select("r.c_custkey", "r.c_name", double("r.c_acctbal").alias("c_acctbal"))
