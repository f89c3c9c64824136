"""Changes published to a store that is filled from the given tables, rows and audit entries read back from it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from csvharbor.operators import changes
from csvharbor.plans import publish
from csvharbor.session import scratch
from csvharbor.sources.store import Store
from csvharbor.specs import Registry
from csvharbor.workload.base import AS_OF_YEAR, CUSTOMER, double, query, table
from csvharbor.workload.changes import GOOD_EDIT, doomed, edits

AS_OF = dt.datetime(AS_OF_YEAR, 6, 1)


def customer_store(spark, sf) -> Store:
    """Customers in three batches; in each, customers with a negative balance count as rejected."""
    registry = Registry()
    registry.register(CUSTOMER)
    store = Store(spark, scratch(spark, "store"), registry)
    key = F.col("c_custkey")
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in CUSTOMER.schema().fields]
    outcome = F.when(F.col("c_acctbal") < 0, "failed").otherwise("accepted").alias("outcome")
    reason = F.when(F.col("c_acctbal") < 0, "in debt").alias("reason")
    upload = F.format_string("u%d", key % 3).alias("upload_id")
    rows = table(spark, sf, "customer").select(upload, key.cast("long").alias("line_number"), reason, F.array(key.cast("string")).alias("row_data"), *typed, outcome)
    for part in range(3):
        store.write(CUSTOMER.key, f"b{part}", rows.filter(key % 3 == part), partition_by=["outcome"])
    store.commit([(CUSTOMER.key, f"b{part}", 0) for part in range(3)])
    return store


def shown(store: Store):
    """What the store holds: accepted rows, rejected rows and audit entries."""
    kinds = ("kind", "key", "balance", "segment", "detail")
    rows = store.rows(CUSTOMER.key).select(F.lit("row"), F.col("c_custkey").cast("long").cast("string"), double("c_acctbal"), "c_mktsegment", F.lit(None).cast("string"))
    failed = store.failed(CUSTOMER.key).select(F.lit("failed"), F.get("row_data", F.lit(0)), F.lit(None).cast("double"), F.lit(None).cast("string"), "reason")
    log = store.log("audit_log").select("action", "row_key", F.col("rows_affected").cast("double"), "column_name", "new_value")
    return rows.toDF(*kinds).union(failed.toDF(*kinds)).union(log.toDF(*kinds))


ROWS = "SELECT 'row' AS kind, CAST(c_custkey AS VARCHAR) AS key, {balance} AS balance, {segment} AS segment, CAST(NULL AS VARCHAR) AS detail FROM customer WHERE c_acctbal >= 0"
FAILED = " UNION ALL SELECT 'failed', CAST(c_custkey AS VARCHAR), NULL, NULL, 'in debt' FROM customer WHERE c_acctbal < 0"
PLAIN = ROWS.format(balance="c_acctbal", segment="c_mktsegment")


@query(PLAIN + " AND c_custkey % 5 <> 0" + FAILED + " UNION ALL SELECT 'row_delete', CAST(c_custkey AS VARCHAR), 1, NULL, NULL FROM customer WHERE c_custkey % 5 = 0 AND c_acctbal >= 0")
def publish_delete(spark, sf):
    store = customer_store(spark, sf)
    keys = changes.parse_keys(doomed(spark, sf), CUSTOMER, store.rows(CUSTOMER.key))
    for _ in range(2):  # the second time it is done already
        publish.delete(store, CUSTOMER, keys, "delete", AS_OF)
    return shown(store)


@query(
    ROWS.format(balance=f"CASE WHEN {GOOD_EDIT} THEN c_custkey + 0.25 ELSE c_acctbal END", segment="CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END") + FAILED + f"""
    UNION ALL SELECT 'cell_edit', CAST(c_custkey AS VARCHAR), 1, 'c_acctbal', '$' || CAST(c_custkey AS VARCHAR) || '.25' FROM customer WHERE {GOOD_EDIT} AND c_acctbal >= 0
    UNION ALL SELECT 'cell_edit', CAST(c_custkey AS VARCHAR), 1, 'c_mktsegment', NULL FROM customer WHERE c_custkey % 6 = 0 AND c_acctbal >= 0""")
def publish_edits(spark, sf):
    store = customer_store(spark, sf)
    publish.edit(store, CUSTOMER, edits(spark, sf), "edit", AS_OF, order="at")
    return shown(store)


@query(
    ROWS.format(balance="c_acctbal", segment="CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END") + FAILED + """
    UNION ALL SELECT 'cell_edit', CAST(c_custkey AS VARCHAR), 1, 'c_mktsegment', 'BUILDING' FROM customer WHERE c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING' AND c_acctbal >= 0
    UNION ALL SELECT 'bulk_edit', NULL, count(*), 'c_mktsegment', 'BUILDING' FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal >= 0""")
def publish_bulk_edit(spark, sf):
    store = customer_store(spark, sf)
    keys = store.rows(CUSTOMER.key).filter("c_custkey % 3 = 0").select("c_custkey")
    publish.bulk_edit(store, CUSTOMER, keys, "c_mktsegment", "BUILDING", "bulk", AS_OF)
    return shown(store)


@query(FAILED.removeprefix(" UNION ALL ").replace("'failed', CAST(c_custkey AS VARCHAR), NULL, NULL, 'in debt'", "'failed' AS kind, CAST(c_custkey AS VARCHAR) AS key, CAST(NULL AS DOUBLE) AS balance, CAST(NULL AS VARCHAR) AS segment, 'in debt' AS detail")
       + " UNION ALL SELECT 'table_reset', NULL, count(*), NULL, NULL FROM customer WHERE c_acctbal >= 0")
def publish_reset(spark, sf):
    store = customer_store(spark, sf)
    publish.reset(store, store.registry.all(), "reset", AS_OF)
    return shown(store)


@query(PLAIN + FAILED + " AND c_custkey % 3 <> 1")
def publish_failed_delete(spark, sf):
    store = customer_store(spark, sf)
    publish.delete_failed(store, CUSTOMER, spark.createDataFrame([("u1",), ("none",)], "id string"), "clean", AS_OF)
    return shown(store)
