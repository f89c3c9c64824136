"""Load history; loads are derived from orders: one load per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from csvharbor.operators import changes, filters, history, views
from csvharbor.workload.base import ORDERS, TABLES, query, table

UPLOADS_SQL = """
    SELECT 'u' || CAST(o_custkey AS VARCHAR) AS id, min(o_orderpriority) AS name,
           'file' || CAST(o_custkey AS VARCHAR) || '.csv' AS file_name,
           count(*) FILTER (WHERE o_orderstatus <> 'F') AS rows_inserted, count(*) FILTER (WHERE o_orderstatus = 'F') AS rows_skipped,
           CASE WHEN o_custkey % 10 = 0 THEN 'rolled_back' ELSE 'active' END AS status, max(o_orderdate) AS uploaded_at
    FROM orders GROUP BY o_custkey"""


def uploads(spark, sf):
    key = F.col("o_custkey")
    loads = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderpriority").alias("name"),
        F.count_if(F.col("o_orderstatus") != "F").alias("rows_inserted"),
        F.count_if(F.col("o_orderstatus") == "F").alias("rows_skipped"),
        F.max("o_orderdate").alias("uploaded_at"),
    )
    return loads.select(
        F.concat(F.lit("u"), key.cast("string")).alias("id"),
        "name",
        F.concat(F.lit("file"), key.cast("string"), F.lit(".csv")).alias("file_name"),
        "rows_inserted",
        "rows_skipped",
        F.when(key % 10 == 0, "rolled_back").otherwise("active").alias("status"),
        "uploaded_at",
    )


def loaded_rows(spark, sf):
    return table(spark, sf, "orders").withColumn("upload_id", F.concat(F.lit("u"), F.col("o_custkey").cast("string")))


def failed_rows(spark, sf):
    rows = loaded_rows(spark, sf).filter("o_orderstatus = 'F'")
    return rows.select(
        "upload_id",
        F.col("o_orderkey").alias("line_number"),
        F.lit("expected 6 columns, got 2").alias("reason"),
        F.array(F.col("o_orderkey").cast("string"), F.col("o_orderpriority")).alias("row_data"),
    )


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_key, count(*) AS row_count FROM {t}" for t in TABLES))
def all_table_counts(spark, sf):
    return history.table_counts({t: table(spark, sf, t) for t in TABLES})


@query("""
    SELECT event_type, event_id, ts, value FROM
      (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_group(spark, sf):
    events = table(spark, sf, "events").select("event_type", "event_id", "ts", "value")
    return history.latest_per(events, "event_type", ["ts", "event_id"])


@query("""
    SELECT event_type, event_id, ts, CAST(rn AS INTEGER) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5""")
def last_five_per_group(spark, sf):
    events = table(spark, sf, "events").select("event_type", "event_id", "ts")
    return history.newest_per(events, "event_type", ["ts", "event_id"])


@query(f"""
    SELECT name, id, status, rows_inserted, CAST(rn AS INTEGER) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY name ORDER BY uploaded_at DESC, id DESC) AS rn FROM ({UPLOADS_SQL})) WHERE rn <= 5""")
def upload_history(spark, sf):
    return history.upload_history(uploads(spark, sf)).select("name", "id", "status", "rows_inserted", "rank")


@query(f"SELECT * FROM ({UPLOADS_SQL}) WHERE name = '1-URGENT' ORDER BY uploaded_at DESC, id DESC LIMIT 1")
def last_load(spark, sf):
    return history.last_upload(uploads(spark, sf), "1-URGENT")


@query(f"""
    WITH u AS ({UPLOADS_SQL}), latest AS
      (SELECT *, row_number() OVER (PARTITION BY name ORDER BY uploaded_at DESC, id DESC) AS rn FROM u WHERE status = 'active')
    SELECT c.table_key, c.row_count, l.file_name, l.rows_inserted, l.rows_skipped, l.uploaded_at
    FROM (SELECT o_orderpriority AS table_key, count(*) AS row_count FROM orders GROUP BY 1) c
    LEFT JOIN (SELECT * FROM latest WHERE rn = 1) l ON l.name = c.table_key""")
def table_stats(spark, sf):
    orders = table(spark, sf, "orders")
    names = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return history.table_stats({n: orders.filter(F.col("o_orderpriority") == n) for n in names}, uploads(spark, sf))


@query("SELECT 'u' || CAST(o_custkey AS VARCHAR) AS upload_id, count(*) AS n_failed FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def failed_counts(spark, sf):
    return history.failed_counts(failed_rows(spark, sf))


@query("""
    SELECT 'u' || CAST(o_custkey AS VARCHAR) AS upload_id, o_orderkey AS line_number, 'expected 6 columns, got 2' AS reason
    FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7 ORDER BY line_number LIMIT 2 OFFSET 2""")
def failed_page(spark, sf):
    return history.failed_page(failed_rows(spark, sf), "u7", 2, 2).select("upload_id", "line_number", "reason")


@query("""
    SELECT o_orderpriority AS upload_id, o_orderkey AS line_number, 'expected 6 columns, got 2' AS reason
    FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY line_number LIMIT 10 OFFSET 20""")
def failed_third_page(spark, sf):
    """The third page of an upload with many failed rows: an upload per priority."""
    rows = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderpriority").alias("upload_id"), F.col("o_orderkey").alias("line_number"), F.lit("expected 6 columns, got 2").alias("reason")
    )
    return history.failed_page(rows, "1-URGENT", 3, 10)


@query("""
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 8 ORDER BY o_orderkey LIMIT 4 OFFSET 4""")
def load_page(spark, sf):
    mine = filters.of_upload(loaded_rows(spark, sf), "u8")
    page = views.page_rows(mine, views.ordering([], ORDERS), 2, 4)
    return page.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(f"""
    SELECT o.o_orderkey, u.id AS upload_id, u.file_name, u.status, u.uploaded_at
    FROM orders o JOIN ({UPLOADS_SQL}) u ON u.id = 'u' || CAST(o.o_custkey AS VARCHAR)""")
def uploads_join_rows(spark, sf):
    joined = history.with_upload(loaded_rows(spark, sf), uploads(spark, sf))
    return joined.select("o_orderkey", "upload_id", "file_name", "status", "uploaded_at")


@query("""
    SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS id, max(l_shipdate) AS uploaded_at, max(l_linenumber) AS seq
    FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) IS NOT NULL""")
def load_life_cycle(spark, sf):
    """States of a load are appended; the state with the greatest number is current."""
    states = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("at"))
    events = states.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), F.col("l_linenumber").alias("seq"), "at")
    current = history.current_uploads(events)
    last = states.groupBy("l_orderkey").agg(F.max("at").alias("uploaded_at"))
    last = last.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), "uploaded_at")
    return current.select("id", "seq").join(last, "id").select("id", "uploaded_at", "seq")


DROPPED_SQL = "o_custkey % 10 = 0"


def dropped(spark, sf):
    return uploads(spark, sf).filter("status = 'rolled_back'").select("id")


@query(f"SELECT 'u' || CAST(o_custkey AS VARCHAR) AS upload_id, o_orderkey AS line_number FROM orders WHERE o_orderstatus = 'F' AND NOT ({DROPPED_SQL})")
def failed_rows_delete(spark, sf):
    return changes.without_uploads(failed_rows(spark, sf), dropped(spark, sf)).select("upload_id", "line_number")


@query(f"SELECT o_orderkey, CASE WHEN {DROPPED_SQL} THEN NULL ELSE 'u' || CAST(o_custkey AS VARCHAR) END AS upload_id FROM orders")
def rows_outlive_upload(spark, sf):
    return changes.detach_uploads(loaded_rows(spark, sf).select("o_orderkey", "upload_id"), dropped(spark, sf))


@query(f"SELECT id, file_name FROM ({UPLOADS_SQL}) WHERE status <> 'rolled_back'")
def active_loads(spark, sf):
    loads = uploads(spark, sf).withColumn("deleted_at", F.when(F.col("status") == "rolled_back", F.col("uploaded_at")))
    return filters.not_deleted(loads).select("id", "file_name")


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT ({DROPPED_SQL}) AND o_custkey % 4 <> 1")
def rollback_load(spark, sf):
    """Loads asked for: some active, some undone before (their rows are gone already), some unknown."""
    loads = uploads(spark, sf)
    done = dropped(spark, sf)
    key = F.substring("id", 2, 20).cast("long")
    asked = loads.filter(key % 4 == 1).select("id").unionByName(done).unionByName(loads.select(F.concat(F.lit("x"), "id").alias("id")))
    rows = changes.lookup_join(loaded_rows(spark, sf), done.withColumnRenamed("id", "upload_id"), ["upload_id"], "left_anti")
    return changes.rollback_uploads(rows, loads, asked).rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"""
    SELECT id, name AS table_key, rows_inserted + rows_skipped AS rows_to_delete, status <> 'rolled_back' AS can_rollback,
           CASE WHEN status = 'rolled_back' THEN 'upload already rolled back' END AS reason
    FROM ({UPLOADS_SQL})
    UNION ALL SELECT 'x' || id, NULL, 0, false, 'upload not found' FROM ({UPLOADS_SQL})""")
def rollback_preview(spark, sf):
    loads = uploads(spark, sf)
    ids = loads.select("id").unionByName(loads.select(F.concat(F.lit("x"), "id").alias("id")))
    return changes.rollback_preview(loaded_rows(spark, sf), loads, ids)


@query(f"SELECT id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 4 = 1 THEN 'rolled_back' ELSE status END AS status FROM ({UPLOADS_SQL})")
def rollback_marks_loads(spark, sf):
    loads = uploads(spark, sf)
    asked = loads.filter(F.substring("id", 2, 20).cast("long") % 4 == 1).select("id")
    return changes.rollback_uploads(loaded_rows(spark, sf), loads, asked).uploads.select("id", "status")
