"""Stored tables asked through their side tables (key table, summaries), after a deletion, edits and a rollback."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csvharbor.operators import exports
from csvharbor.operators.filters import Filter
from csvharbor.operators.history import UPLOAD_SCHEMA
from csvharbor.plans import ingest, lookup, publish
from csvharbor.session import scratch
from csvharbor.sources.store import Store
from csvharbor.specs import Registry, TableSpec
from csvharbor.streaming import drop
from csvharbor.workload.base import AS_OF_YEAR, LINEITEM, ORDERS, PART, double, query, spec, table

AS_OF = dt.datetime(AS_OF_YEAR, 6, 1)
BATCHES = 3


def filled(spark, sf, spec: TableSpec, **sides) -> Store:
    """A table in batches by its first key column, one upload each."""
    registry = Registry()
    registry.register(spec)
    store = Store(spark, scratch(spark, "store"), registry, buckets=8, **sides)
    part = F.col(spec.key_columns[0]) % BATCHES
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema().fields]
    rows = table(spark, sf, spec.key)
    for k in range(BATCHES):
        mine = rows.filter(part == k).select(
            F.lit(f"u{k}").alias("upload_id"), F.monotonically_increasing_id().alias("line_number"), F.lit(None).cast("string").alias("reason"),
            F.lit(None).cast("array<string>").alias("row_data"), *typed, F.lit("accepted").alias("outcome"),
        )
        store.write(spec.key, f"b{k}", mine, partition_by=["outcome"])
    given = {"name": spec.key, "action": "upload", "status": "active", "seq": 0}
    uploads = [tuple({**given, "id": f"u{k}", "file_name": f"{k}.csv"}.get(f.name) for f in UPLOAD_SCHEMA.fields) for k in range(BATCHES)]
    store.write("uploads", "first", spark.createDataFrame(uploads, UPLOAD_SCHEMA))
    store.commit([*((spec.key, f"b{k}", 0) for k in range(BATCHES)), ("uploads", "first", 0)])
    store.settle(spec.key)
    return store


def changed(spark, sf, spec: TableSpec, *steps: str, **sides) -> Store:
    """Some rows of the second batch deleted, some of the third edited (to 17.5), the first one rolled back, as the steps say."""
    store = filled(spark, sf, spec, **sides)
    first = F.col(spec.key_columns[0])
    keys = table(spark, sf, spec.key).select(*[F.col(k).cast(spec.schema()[k].dataType).alias(k) for k in spec.key_columns])
    if "delete" in steps:
        publish.delete(store, spec, keys.filter((first % BATCHES == 1) & (first % 4 == 0)), "delete", AS_OF)
    if "edit" in steps:
        edits = keys.filter((first % BATCHES == 2) & (first % 4 == 0)).withColumn("column", F.lit("o_totalprice")).withColumn("value", F.lit("17.5"))
        publish.edit(store, spec, edits, "edit", AS_OF)
    if "undo" in steps:
        ingest.rollback(store, spark.createDataFrame([("u0",)], "id string"), "undo", AS_OF)
    return store


NOT_DELETED = "NOT ({0} % 3 = 1 AND {0} % 4 = 0)"
PRICES = "SELECT *, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 4 = 0 THEN 17.5 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 3 <> 0"


@query(f"""
    SELECT DISTINCT CAST(a.o_orderkey AS BIGINT) AS o_orderkey FROM (SELECT o_orderkey * 2 AS o_orderkey FROM orders) a
    WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND {NOT_DELETED.format('o_orderkey')})""")
def indexed_existing_keys(spark, sf):
    """Half of the asked keys are there; the key table answers alone."""
    store = changed(spark, sf, ORDERS, "delete", "undo", keyed=True)
    asked = table(spark, sf, "orders").select((F.col("o_orderkey") * 2).cast("decimal(28,10)").alias("o_orderkey"))
    return lookup.existing(store, ORDERS, asked).select(F.col("o_orderkey").cast("long"))


@query("""
    SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_quantity AS DOUBLE) AS l_quantity
    FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_linenumber % 2 = 1""")
def indexed_rows_of_keys(spark, sf):
    """Rows of many composite keys, all in two of three batches."""
    store = filled(spark, sf, LINEITEM, keyed=True)
    keys = table(spark, sf, "lineitem").filter((F.col("l_orderkey") % 3 != 0) & (F.col("l_linenumber") % 2 == 1))
    keys = keys.select(*[F.col(k).cast("decimal(28,10)").alias(k) for k in LINEITEM.key_columns])
    found = lookup.rows_of(store, LINEITEM, keys)
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")], double("l_quantity").alias("l_quantity"))


NUMBERS = ("o_orderkey", "o_custkey", "price")


@query(
    f"WITH p AS ({PRICES}) SELECT 'orders' AS table_key, count(*) AS row_count, 'rows' AS what, CAST(NULL AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS mean,"
    " CAST(NULL AS DOUBLE) AS least, CAST(NULL AS DOUBLE) AS greatest FROM p"
    + "".join(
        f" UNION ALL SELECT 'orders', count({c}), '{'o_totalprice' if c == 'price' else c}', CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE),"
        f" round(CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / count({c}), 4), CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE) FROM p"
        for c in NUMBERS
    )
)
def summary_counts(spark, sf):
    """Row count and numeric profile from the batches' summaries; no row is read for them."""
    store = changed(spark, sf, ORDERS, "edit", "undo", summarized=True)
    counts = lookup.table_counts(store, [ORDERS]).select("table_key", "row_count", F.lit("rows").alias("what"))
    profile = lookup.column_profile(store, ORDERS).select(
        F.lit("orders").alias("table_key"), F.col("count").alias("row_count"), F.col("column_name").alias("what"), double("sum").alias("total"),
        F.round(double("avg"), 4).alias("mean"), double("min").alias("least"), double("max").alias("greatest"),
    )
    return counts.unionByName(profile, allowMissingColumns=True)


@query(f"""
    WITH p AS ({PRICES})
    SELECT 'o_orderstatus' AS column_name, count(*) AS "rows", count(*) - count(o_orderstatus) AS nulls, min(o_orderstatus) AS least, max(o_orderstatus) AS greatest,
           count(DISTINCT o_orderstatus) AS "distinct" FROM p
    UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority), min(o_orderpriority), max(o_orderpriority), count(DISTINCT o_orderpriority) FROM p""")
def summary_facts(spark, sf):
    """Text columns: nulls, extremes, and different values by merged sketches, exact while they are few."""
    store = changed(spark, sf, ORDERS, "undo", summarized=True)
    return lookup.column_facts(store, ORDERS).filter("column_name IN ('o_orderstatus', 'o_orderpriority')").drop("quantiles")


NAME = "p_name ILIKE '{0}' OR p_brand ILIKE '{0}' OR p_type ILIKE '{0}'"


@query(f"""
    SELECT 'ring' AS asked, p_partkey FROM part WHERE {NAME.format('%ring%')} UNION ALL SELECT 'wild', p_partkey FROM part WHERE {NAME.format('%rand#1_%')}
    UNION ALL SELECT 'short', p_partkey FROM part WHERE {NAME.format('%ol%')} UNION ALL SELECT 'red', p_partkey FROM part WHERE p_name ILIKE 'red%'
    UNION ALL SELECT 'bolt', p_partkey FROM part WHERE p_name ILIKE '%bolt' UNION ALL SELECT 'none', p_partkey FROM part WHERE p_name ILIKE '%xyzzy%'""")
def indexed_search(spark, sf):
    """Searches and text filters that open only files whose runs of three characters allow a hit."""
    store = filled(spark, sf, PART, searched=True)
    asked = {"ring": "RiNg", "wild": "rand#1_", "short": "oL"}
    found = [lookup.search(store, PART, text).select(F.lit(name).alias("asked"), "p_partkey") for name, text in asked.items()]
    for name, op, text in (("red", "starts", "RED"), ("bolt", "ends", "Bolt"), ("none", "contains", "xyzzy")):
        found.append(lookup.matching(store, PART, Filter("p_name", op, text)).select(F.lit(name).alias("asked"), "p_partkey"))
    return reduce(DataFrame.unionByName, found).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS order_text, CASE WHEN o_orderkey % 50 IN (1, 2) THEN 'price' WHEN o_orderkey % 50 = 3 THEN 'status' ELSE '' END AS changed
    FROM orders WHERE o_orderkey % 7 <> 0
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'new' FROM orders WHERE o_orderkey % 7 = 0""")
def preview_by_digest(spark, sf):
    """A file of mostly unchanged rows against a stored table that lacks a seventh of them; only changed rows are fetched."""
    registry = Registry()
    registry.register(PLAIN)
    store = Store(spark, scratch(spark, "store"), registry, keyed=True, buckets=8)
    orders, key = table(spark, sf, "orders"), F.col("o_orderkey")
    text = {"order": key.cast("string"), "status": F.col("o_orderstatus"), "price": F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "ordered": F.date_format("o_orderdate", "yyyy-MM-dd")}
    before, after = scratch(spark, "before"), scratch(spark, "after")
    older = {"price": F.when((key % 50).isin(1, 2), F.concat(F.lit("1"), text["price"])).otherwise(text["price"]), "status": F.when(key % 50 == 3, "?").otherwise(text["status"])}
    exports.write_csv(orders.filter(key % 7 != 0).select(*[c.alias(n) for n, c in (text | older).items()]), before)
    exports.write_csv(orders.select(*[c.alias(n) for n, c in text.items()]), after)
    ingest.load(store, PLAIN, before, "first", AS_OF, pathGlobFilter="*.csv")
    shown = lookup.previewed(store, ingest.incoming(spark, PLAIN, after, pathGlobFilter="*.csv"), AS_OF_YEAR)
    order = F.try_element_at("values", F.lit("order")).alias("order_text")
    return shown.updates.select(order, F.array_join("changed", ",").alias("changed")).unionByName(shown.new.select(order, F.lit("new").alias("changed")))


PLAIN = spec("plain", "order", "order status price:numeric ordered:date")
BY_PRICE = (("o_totalprice", "desc"),)
DEEP = (10, 100_000_000)


@query(f"""
    WITH p AS ({PRICES}), n AS (SELECT count(*) AS c FROM p), r AS (SELECT o_orderkey, price, o_orderpriority, row_number() OVER (ORDER BY price DESC, o_orderkey) - 1 AS place FROM p),
    pages(asked) AS (VALUES (10), (100000000)), shown AS (SELECT asked, least(asked, greatest((c + 24) // 25, 1)) AS page FROM pages, n)
    SELECT asked, CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(price AS DOUBLE) AS price, o_orderpriority FROM r JOIN shown ON place // 25 = page - 1""")
def shared_deep_pages(spark, sf):
    """Two pages, the second one past the end, from one table of ranges that edits and a rollback have gone by."""
    store = changed(spark, sf, ORDERS, "edit", "undo", sorted_by={ORDERS.key: [BY_PRICE]})
    shown = [store.page(ORDERS.key, BY_PRICE, page).select(F.lit(page).alias("asked"), F.col("o_orderkey").cast("long"), double("o_totalprice").alias("price"), "o_orderpriority") for page in DEEP]
    return reduce(DataFrame.unionByName, shown)


VISIT = spec("visit", "user_id event_type", "user_id:numeric event_type event_id:numeric")
#: Days after the first load on which the loads come; the keys are kept apart for three days.
LOAD_DAYS = (0, 2, 3, 9)


@query("""
    WITH RECURSIVE days(part, day) AS (VALUES (0, 0), (1, 2), (2, 3), (3, 9)),
    here AS (SELECT DISTINCT user_id, event_type, event_id % 4 AS part FROM events),
    walk AS (
      SELECT user_id, event_type, CAST(-1 AS BIGINT) AS part, -100 AS since, 0 AS admitted FROM (SELECT DISTINCT user_id, event_type FROM events)
      UNION ALL
      SELECT w.user_id, w.event_type, w.part + 1, CASE WHEN h.part IS NOT NULL AND d.day - w.since >= 3 THEN d.day ELSE w.since END,
             w.admitted + CASE WHEN h.part IS NOT NULL AND d.day - w.since >= 3 THEN 1 ELSE 0 END
      FROM walk w JOIN days d ON d.part = w.part + 1 LEFT JOIN here h ON h.user_id = w.user_id AND h.event_type = w.event_type AND h.part = w.part + 1)
    SELECT user_id, event_type, CAST(admitted AS BIGINT) AS accepted, n - admitted AS held_back
    FROM walk JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) USING (user_id, event_type) WHERE part = 3""")
def unique_stream(spark, sf):
    """Keys that repeat within a load, across loads before their time is over, and after it; every load is a restart."""
    registry = Registry()
    registry.register(VISIT)
    store = Store(spark, scratch(spark, "store"), registry)
    inbox, checkpoint = scratch(spark, "inbox"), scratch(spark, "progress")
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    for part, day in enumerate(LOAD_DAYS):
        exports.write_csv(events.filter(F.col("event_id") % len(LOAD_DAYS) == part), f"{inbox}/{part}")
        at = AS_OF + dt.timedelta(days=day)
        started = drop.start_load(store, VISIT, f"{inbox}/*", checkpoint, lambda at=at: at, unique_within=dt.timedelta(days=3))
        started.awaitTermination()
    cell = [F.get("row_data", F.lit(k)) for k in range(2)]
    failed = store.failed(VISIT.key).filter(F.col("reason").startswith("duplicate key")).select(cell[0].alias("user_id"), cell[1].alias("event_type"), F.lit(0).alias("passed"))
    rows = store.rows(VISIT.key).select(F.col("user_id").cast("long").cast("string"), "event_type", F.lit(1).alias("passed")).unionByName(failed)
    counts = rows.groupBy(F.col("user_id").cast("long"), "event_type").agg(F.count_if(F.col("passed") == 1).alias("accepted"), F.count_if(F.col("passed") == 0).alias("held_back"))
    return counts
