"""The audit log; entries are derived from events, ``as_of`` is fixed."""

from __future__ import annotations

from pyspark.sql import functions as F

from csvharbor.operators import audit, filters
from csvharbor.workload.base import day, query, table
from csvharbor.workload.cells import ACTION_OF, SEVERITY_OF, spark_case, sql_case

AS_OF = day("2024-03-15 00:00:00")
LOG_SQL = f"""
    SELECT CAST(event_id AS VARCHAR) AS id, {sql_case('event_type', ACTION_OF)} AS action, {sql_case('event_type', SEVERITY_OF)} AS severity,
           'table_' || CAST(user_id % 4 AS VARCHAR) AS table_key, 'user' || CAST(user_id AS VARCHAR) || '@example.com' AS user_email,
           CASE WHEN event_id % 3 = 0 THEN '10.1.2.' || CAST(user_id % 256 AS VARCHAR) END AS ip_address,
           CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS row_key, nullif(CAST(event_id % 7 AS INTEGER), 0) AS rows_affected, ts AS created_at
    FROM events"""
COLUMNS = ["id", "action", "severity", "table_key", "user_email", "ip_address", "row_key", "rows_affected", "created_at"]


def log(spark, sf):
    key, user = F.col("event_id"), F.col("user_id").cast("string")
    given = table(spark, sf, "events").select(
        key.cast("string").alias("id"),
        spark_case("event_type", ACTION_OF).alias("action"),
        F.concat(F.lit("table_"), (F.col("user_id") % 4).cast("string")).alias("table_key"),
        F.concat(F.lit("user"), user, F.lit("@example.com")).alias("user_email"),
        F.when(key % 3 == 0, F.concat(F.lit("10.1.2."), (F.col("user_id") % 256).cast("string"), F.lit(":5000"))).otherwise("unknown").alias("ip_address"),
        F.when(key % 5 == 0, "  ").otherwise(user).alias("row_key"),
        (key % 7).alias("rows_affected"),
        F.col("ts").alias("created_at"),
    )
    return audit.entries(given)


@query(LOG_SQL)
def audit_append(spark, sf):
    return log(spark, sf).select(*[F.col(c).cast("timestamp_ntz").alias(c) if c == "created_at" else c for c in COLUMNS])


@query(f"SELECT id, action, created_at FROM ({LOG_SQL}) ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def audit_page(spark, sf):
    page = audit.page(log(spark, sf), audit.AuditFilter(AS_OF), offset=100)
    return page.select("id", "action", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


BUSY = audit.AuditFilter(AS_OF, action="upload", table_key="table_1", severity="high", start=day("2024-01-05"), end=filters.end_of_day(day("2024-01-20")))
BUSY_SQL = """action = 'upload' AND table_key = 'table_1' AND severity = 'high'
    AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 23:59:59'"""


@query(f"SELECT id, severity FROM ({LOG_SQL}) WHERE {BUSY_SQL} ORDER BY created_at DESC, id LIMIT 50")
def audit_filtered_page(spark, sf):
    return audit.page(log(spark, sf), BUSY).select("id", "severity")


@query(f"SELECT count(*) FILTER (WHERE {BUSY_SQL}) AS matching, count(*) AS total FROM ({LOG_SQL})")
def audit_count(spark, sf):
    return audit.count(log(spark, sf), BUSY)


@query("SELECT count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 23:59:59'")
def audit_range(spark, sf):
    end = filters.end_of_day(day("2024-01-12"))
    return filters.in_time_range(table(spark, sf, "events"), "ts", AS_OF, day("2024-01-10"), end).agg(F.count("*").alias("n"))


@query(f"SELECT action, severity, table_key, count(*) AS n FROM ({LOG_SQL}) GROUP BY 1, 2, 3")
def audit_totals(spark, sf):
    return audit.counts_by(log(spark, sf), ["action", "severity", "table_key"])


EXPORT_SQL = """id AS "ID", strftime(created_at, '%Y-%m-%d %H:%M:%S') AS "Timestamp", action AS "Action", severity AS "Severity", table_key AS "Table",
    user_email AS "User Email", '' AS "User Name", coalesce(ip_address, '') AS "IP Address", coalesce(row_key, '') AS "Row Key", '' AS "Column",
    '' AS "Old Value", '' AS "New Value", CAST(coalesce(rows_affected, 0) AS VARCHAR) AS "Rows Affected", '' AS "Upload ID", '' AS "Reason" """


@query(f"SELECT {EXPORT_SQL} FROM ({LOG_SQL})")
def audit_export(spark, sf):
    return audit.export_rows(log(spark, sf), audit.AuditFilter(AS_OF))


@query(f"""
    SELECT "ID", "Created At" FROM (SELECT id AS "ID", strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS "Created At", created_at FROM ({LOG_SQL}))
    ORDER BY created_at DESC, "ID" LIMIT 100000""")
def audit_export_capped(spark, sf):
    return audit.export_rows_time_last(log(spark, sf), audit.AuditFilter(AS_OF)).select("ID", "Created At")


@query("""
    SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'archive' ELSE 'log' END AS part, event_type, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1, 2""")
def archive_split(spark, sf):
    """Both parts of the log after archiving, with a third of the old entries moved by an earlier, interrupted run."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type", F.col("ts").alias("created_at"))
    early = events.filter(filters.older_than(events, "created_at", AS_OF, days=60) & (F.col("id") % 3 == 0)).withColumn("archived_at", F.lit("2024-03-14").cast("timestamp"))
    archive = early.unionByName(audit.to_archive(events, early, AS_OF, days=60))
    hot = audit.hot_part(events, AS_OF, days=60).withColumn("archived_at", F.lit(None).cast("timestamp"))
    part = F.when(F.col("archived_at").isNull(), "log").otherwise("archive")
    both = archive.unionByName(hot).groupBy(part.alias("part"), "event_type")
    return both.agg(F.count("*").alias("n"), F.max("created_at").alias("newest"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-02-28'")
def purge_archive(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"))
    return audit.after_purge(orders, day("2004-02-28"), 6).withColumnRenamed("created_at", "o_orderdate")


@query("SELECT id, created_at FROM (SELECT CAST(event_id AS VARCHAR) AS id, ts AS created_at FROM events WHERE ts < TIMESTAMP '2024-01-15') ORDER BY created_at DESC, id LIMIT 50")
def archive_page(spark, sf):
    moved = audit.to_archive(log(spark, sf), None, AS_OF, days=60)
    return audit.page(moved, audit.AuditFilter(AS_OF)).select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 30 DAY >= TIMESTAMP '2024-02-14 06:00:00'")
def ttl_cleanup(spark, sf):
    sessions = table(spark, sf, "events").select("event_id", (F.col("ts") + F.expr("interval 30 days")).alias("expires_at"))
    return audit.unexpired(sessions, day("2024-02-14 06:00:00")).select("event_id")


@query("""
    SELECT CASE o_orderstatus WHEN 'O' THEN 'cell_edit' WHEN 'F' THEN 'row_delete' ELSE 'row_restore' END AS action,
           CASE WHEN o_orderstatus = 'F' THEN 'high' ELSE 'medium' END AS severity, CAST(o_orderkey AS VARCHAR) AS row_key, o_orderpriority AS old_value, 1 AS rows_affected
    FROM orders""")
def legacy_history(spark, sf):
    old = F.when(F.col("o_orderstatus") == "O", "edit").when(F.col("o_orderstatus") == "F", "delete").otherwise("restore")
    history = table(spark, sf, "orders").select(
        old.alias("action"),
        F.lit("orders").alias("table_key"),
        F.col("o_orderkey").cast("string").alias("row_key"),
        F.col("o_orderpriority").alias("old_value"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
    # The migrated entries are appended to a log that is there already.
    both = log(spark, sf).unionByName(audit.from_legacy(history)).filter("table_key = 'orders'")
    return both.select("action", "severity", "row_key", "old_value", "rows_affected")


@query("""
    SELECT 'template_' || CASE c_custkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END AS action, 'low' AS severity,
           CASE c_custkey % 3 WHEN 0 THEN 'Created' WHEN 1 THEN 'Updated' ELSE 'Deleted' END || ' template: ' || c_name AS reason
    FROM customer""")
def template_audit(spark, sf):
    at = F.lit("2024-03-15").cast("timestamp")
    named = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.lit("customer").alias("table_key"))
    parts = [audit.template_entries(named.filter(F.col("c_custkey") % 3 == i), change, at) for i, change in enumerate(("create", "update", "delete"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("action", "severity", "reason")
