"""Whole jobs over CSV files that are written from the given tables into the shared scratch folder first."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from csvharbor.operators import audit, exports
from csvharbor.operators.filters import Filter
from csvharbor.operators.joins import small_side
from csvharbor.plans import ingest, preview, retention
from csvharbor.session import scratch
from csvharbor.sources import records
from csvharbor.sources.store import Store
from csvharbor.specs import Registry
from csvharbor.streaming import drop, feed
from csvharbor.streaming.progress import LoadProgress
from csvharbor.workload.base import AS_OF_YEAR, ORDERS, double, query, table
from csvharbor.workload.history import failed_rows
from csvharbor.workload.validation import BROKEN, FIRST_SQL, FORM, WRONG_TEXT

AS_OF = dt.datetime(AS_OF_YEAR, 6, 1)
DOCUMENT = ("doc_id", "lang", "source", "text")


def write_documents(spark, sf) -> str:
    path = scratch(spark, "documents")
    exports.write_csv(table(spark, sf, "documents").select(*DOCUMENT), path)
    return path


@query("SELECT doc_id, lang, source, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS text_length FROM documents")
def csv_roundtrip(spark, sf):
    """Whole texts, line breaks, quotes and commas included, written as CSV and scanned back."""
    found = records.scan(spark, write_documents(spark, sf), DOCUMENT, pathGlobFilter="*.csv")
    rows = found.records.join(small_side(found.headers), "file").filter("record_no > header_no")
    cells = rows.select(records.tokenize(F.col("raw")).alias("t"))
    cell = [F.get("t", F.lit(i)) for i in range(len(DOCUMENT))]
    return cells.select(
        cell[0].cast("long").alias("doc_id"), cell[1].alias("lang"), cell[2].alias("source"), F.md5(cell[3]).alias("text_md5"),
        F.length(cell[3]).alias("text_length"),
    )


def write_forms(spark, sf, part=None) -> str:
    """Orders, or a part of them, as messy text, broken at the places the validation queries use."""
    key = F.col("o_orderkey")
    good = {
        "order": F.format_string('="%d"', key),
        "status": F.col("o_orderstatus"),
        "price": F.concat(F.lit("$"), F.format_number("o_totalprice", 2)),
        "ordered": F.when(key % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "MMM d, yyyy")),
        "urgent": F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").otherwise("No"),
    }
    cells = [F.when(key % BROKEN[n] == 0, WRONG_TEXT[n]).otherwise(c).alias(n) for n, c in good.items()]
    path = scratch(spark, "forms")
    orders = table(spark, sf, "orders")
    exports.write_csv((orders if part is None else orders.filter(part)).select(*cells), path)
    return path


def forms_store(spark) -> Store:
    registry = Registry()
    registry.register(FORM)
    return Store(spark, scratch(spark, "store"), registry)


FILE_REASON_SQL = FIRST_SQL.replace("""WHEN o_orderkey % 31 = 0 THEN 'missing required column "status"' """, "").replace(" AND o_orderkey % 31 <> 0", "")
LOADED_SQL = f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS order_text, 'accepted' AS outcome, o_orderstatus AS status, o_totalprice AS price,
           CAST(o_orderdate AS DATE) AS ordered, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderpriority = '1-URGENT' END AS urgent, CAST(NULL AS VARCHAR) AS reason
    FROM orders WHERE ({FILE_REASON_SQL}) IS NULL"""


@query(f"""
    {LOADED_SQL} UNION ALL
    SELECT CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE '="' || CAST(o_orderkey AS VARCHAR) || '"' END, 'failed', NULL, NULL, NULL, NULL, {FILE_REASON_SQL}
    FROM orders WHERE ({FILE_REASON_SQL}) IS NOT NULL""")
def load_job(spark, sf):
    """Files to accepted and failed rows through the store."""
    store = forms_store(spark)
    ingest.load(store, FORM, write_forms(spark, sf), "b1", AS_OF, pathGlobFilter="*.csv")
    accepted = store.rows(FORM.key).select(
        F.col("order").alias("order_text"), F.lit("accepted").alias("outcome"), "status", double("price").alias("price"), "ordered", "urgent",
        F.lit(None).cast("string").alias("reason"),
    )
    failed = store.failed(FORM.key).select(F.get("row_data", F.lit(0)).alias("order_text"), F.lit("failed").alias("outcome"), "reason")
    return accepted.unionByName(failed, allowMissingColumns=True)


@query(f"""
    SELECT status, count(*) AS rows_inserted, CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) AS total FROM ({LOADED_SQL}) GROUP BY status""")
def stream_ingest(spark, sf):
    """The same files arriving in two drop directories, each with a checkpoint of its own, a few per micro-batch."""
    store = forms_store(spark)
    for part in (F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 2 == 1):
        started = drop.start_load(store, FORM, write_forms(spark, sf, part), scratch(spark, "progress"), lambda: AS_OF, max_files=4)
        started.awaitTermination()
    totals = store.rows(FORM.key).groupBy("status").agg(F.count("*").alias("rows_inserted"), F.sum("price").alias("total"))
    return totals.withColumn("total", double("total"))


@query(f"""
    SELECT CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS order_text,
           CASE WHEN ({FILE_REASON_SQL}) IS NOT NULL THEN 'error' WHEN o_orderkey % 3 = 2 THEN 'new' ELSE 'update' END AS status,
           CASE WHEN ({FILE_REASON_SQL}) IS NULL AND o_orderkey % 3 <> 2 THEN
             CASE WHEN o_orderkey % 3 = 1 THEN 'price' ELSE '' END || CASE WHEN o_orderkey % 29 = 0 AND o_orderkey % 3 = 1 THEN ',urgent' WHEN o_orderkey % 29 = 0 THEN 'urgent' ELSE '' END
           END AS changed
    FROM orders""")
def preview_job(spark, sf):
    """Incoming files against a table that has two thirds of the orders, half of those at another price."""
    key = F.col("o_orderkey")
    existing = table(spark, sf, "orders").filter(key % 3 != 2).select(
        key.cast("string").alias("order"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_totalprice").cast("decimal(28,10)") + F.when(key % 3 == 1, 1).otherwise(0)).cast("decimal(28,10)").alias("price"),
        F.col("o_orderdate").cast("date").alias("ordered"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    data = ingest.incoming(spark, FORM, write_forms(spark, sf), pathGlobFilter="*.csv")
    shown = preview.preview(data, existing, AS_OF_YEAR)
    text = F.nullif(F.try_element_at("values", F.lit("order")), F.lit("")).alias("order_text")
    updates = shown.updates.select(text, F.lit("update").alias("status"), F.array_join("changed", ",").alias("changed"))
    rest = [df.select(text, F.lit(s).alias("status"), F.lit(None).cast("string").alias("changed")) for s, df in (("new", shown.new), ("error", shown.errors))]
    return updates.unionByName(rest[0]).unionByName(rest[1])


COUNTS_SQL = f"""
    SELECT count(*) AS total_rows, count(*) FILTER (({FILE_REASON_SQL}) IS NULL) AS rows_inserted, count(*) FILTER (({FILE_REASON_SQL}) IS NOT NULL) AS rows_skipped
    FROM orders"""


@query(COUNTS_SQL)
def load_counts(spark, sf):
    """The counts of a load as its write observed them; what was written is not read again for them."""
    counts = ingest.load(forms_store(spark), FORM, write_forms(spark, sf), "b1", AS_OF, pathGlobFilter="*.csv").counts
    return spark.createDataFrame([tuple(counts[c] for c in ("total_rows", "rows_inserted", "rows_skipped"))], "total_rows long, rows_inserted long, rows_skipped long")


@query(f"SELECT 'starting' AS phase, 0 AS total_rows, 0 AS rows_inserted, 0 AS rows_skipped, 0.0::DOUBLE AS percent UNION ALL SELECT 'complete', *, 100.0 FROM ({COUNTS_SQL})")
def load_progress(spark, sf):
    """First and last note of a streaming load whose micro-batches are bounded by bytes."""
    store, source = forms_store(spark), write_forms(spark, sf)
    noted = LoadProgress(spark, scratch(spark, "progress"), f"load_{FORM.key}")
    drop.start_load(store, FORM, source, scratch(spark, "checkpoint"), lambda: AS_OF, max_bytes=4_000_000, progress_log=noted).awaitTermination()
    noted.finished()
    return noted.rows().filter("phase IN ('starting', 'complete')").select("phase", "total_rows", "rows_inserted", "rows_skipped", "percent")


PRICE = "CASE WHEN o_totalprice = floor(o_totalprice) THEN printf('%.0f', o_totalprice) ELSE printf('%.2f', o_totalprice) END"


@query(f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, {PRICE} AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate
    FROM orders WHERE o_totalprice >= 100000 AND o_orderpriority ILIKE '%low%'""")
def export_table(spark, sf):
    """A view exported as CSV files and scanned back."""
    chosen = [Filter("o_totalprice", "gte", "100000")]
    path = scratch(spark, "export")
    exports.write_csv(exports.export_view(table(spark, sf, "orders"), ORDERS, "low", chosen), path)
    found = records.scan(spark, path, ORDERS.names, pathGlobFilter="*.csv")
    rows = found.records.join(small_side(found.headers), "file").filter("record_no > header_no").select(records.tokenize(F.col("raw")).alias("t"))
    wanted = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return rows.select(*[F.get("t", F.lit(ORDERS.names.index(c))).alias(c) for c in wanted])


@query("""
    SELECT o_orderkey AS "_line", 'expected 6 columns, got 2' AS "_error", CAST(o_orderkey AS VARCHAR) AS "Order", o_orderpriority AS "Priority", '' AS "Note"
    FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7""")
def export_failed_rows(spark, sf):
    return exports.export_failed(failed_rows(spark, sf), "u7", ["Order", "Priority", "Note"])


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def audit_feed(spark, sf):
    """Running counts per day and action; the state after all input is the batch result."""
    events = table(spark, sf, "events").select("ts", "event_type")
    source, target = scratch(spark, "feed"), scratch(spark, "feed-counts")
    events.write.parquet(source)
    counts = feed.running_counts(feed.audit_stream(spark, source, events.schema, 4), "ts", ["event_type"])
    running = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(target))
        .option("checkpointLocation", scratch(spark, "feed-state"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.parquet(target).withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


def event_log(spark, sf) -> Store:
    """Events as audit entries in two batches."""
    store = Store(spark, scratch(spark, "store"), Registry())
    events = table(spark, sf, "events")
    late = F.col("event_id") % 2 == 0
    for batch, part in (("even", events.filter(late)), ("odd", events.filter(~late))):
        given = part.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
        store.write("audit_log", batch, audit.entries(given))
        store.commit([("audit_log", batch, 0)])
    return store


def parts(store: Store):
    log = store.log("audit_log").select(F.lit("log").alias("part"), "action", "id")
    archive = store.log("audit_log_archive").select(F.lit("archive").alias("part"), "action", "id")
    return log.unionByName(archive).withColumnRenamed("action", "event_type")


@query("""
    SELECT CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'archive' ELSE 'log' END AS part, event_type, count(*) AS n FROM events
    WHERE ts >= TIMESTAMP '2024-01-06' GROUP BY 1, 2""")
def retention_job(spark, sf):
    """Stored log: archive after 60 days, then purge after six years counted from a date that cuts off the first days."""
    store = event_log(spark, sf)
    retention.run(store, "keep", dt.datetime(2024, 3, 21), days=60, years=6)
    retention.purge(store, dt.datetime(2030, 1, 6), years=6)
    return parts(store).groupBy("part", "event_type").agg(F.count("*").alias("n"))


@query("""
    SELECT CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'archive' ELSE 'log' END AS part, event_type, count(*) AS n, count(DISTINCT event_id) AS ids, 1 AS late_moves
    FROM events GROUP BY 1, 2""")
def archive_in_steps(spark, sf):
    """The move in steps of days that is stopped after two of them and taken up again: nothing lost, nothing twice."""
    store, as_of = event_log(spark, sf), dt.datetime(2024, 3, 21)
    step = max(1, table(spark, sf, "events").count() // 12)
    retention.archive_steps(store, "first", as_of, days=60, step_rows=step, most_steps=2)
    retention.archive_steps(store, "again", as_of, days=60, step_rows=step)
    several = retention.moves(store).agg((F.count_if(F.col("move").startswith("again")) >= 1).cast("int").alias("late_moves"))
    counts = parts(store).groupBy("part", "event_type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    return counts.withColumn("late_moves", F.lit(several.first().late_moves))
