"""The SQL functions, called in SQL over the same messy texts that the column functions are tried on."""

from __future__ import annotations

from pyspark.sql import functions as F

from csvharbor.functions import cells, sql
from csvharbor.workload.base import AS_OF_YEAR, pick, query, table
from csvharbor.workload.cells import DATE_FORMATS, STATES, key, wrapped


def messy_orders(spark, sf) -> None:
    """The view ``messy``: a column of texts for each function."""
    price, at = F.col("o_totalprice"), (F.col("o_custkey") % 50).cast("int")
    commas, plain = F.format_number(price, 2), price.cast("decimal(18,2)").cast("string")
    number = pick(key(), F.concat(F.lit("$"), commas), F.concat(F.lit("($ "), commas, F.lit(")")), F.concat(F.lit(" +€"), plain, F.lit(" ")), F.concat(plain, F.lit("e1")))
    words = [w.upper() if i % 2 else f" {w}" for i, w in enumerate(cells.TRUE_WORDS + cells.FALSE_WORDS)]
    name = F.get(F.array(*[F.lit(s[0]) for s in STATES]), at)
    table(spark, sf, "orders").select(
        "o_orderkey",
        wrapped(F.col("o_orderpriority"), key()).alias("cell"),
        number.alias("number"),
        F.concat(F.lit(" "), pick(key(), *[F.date_format("o_orderdate", f) for f in DATE_FORMATS], F.date_format("o_orderdate", "yyyy-13-dd"))).alias("day"),
        pick(key(), *[F.lit(w) for w in words], F.lit("maybe")).alias("word"),
        pick(key(), F.initcap(name), F.lit(" Ontario ")).alias("state"),
        pick(key(), F.lit("x Duplicate KEY y"), F.lit("invalid date in row"), F.lit("other")).alias("reason"),
    ).createOrReplaceTempView("messy")
    sql.register(spark)


@query(f"""
    SELECT o_orderkey, o_orderpriority AS cleaned, CASE o_orderkey % 4 WHEN 1 THEN -o_totalprice WHEN 3 THEN NULL ELSE o_totalprice END AS price,
           CASE WHEN o_orderkey % 10 < 9 THEN CAST(o_orderdate AS DATE) END AS ordered, CASE WHEN o_orderkey % 11 < 5 THEN true WHEN o_orderkey % 11 < 10 THEN false END AS flag,
           CASE WHEN o_orderkey % 2 = 1 THEN 'Ontario' ELSE list_extract({[s[1] for s in STATES]}, CAST(o_custkey % 50 + 1 AS INTEGER)) END AS state,
           list_extract(['DB001', 'VAL001', 'ERR000'], CAST(o_orderkey % 3 + 1 AS INTEGER)) AS code
    FROM orders""")
def sql_cells(spark, sf):
    messy_orders(spark, sf)
    return spark.sql(f"""
        SELECT o_orderkey, csv_clean_cell(cell) AS cleaned, CAST(csv_numeric(number) AS DOUBLE) AS price, csv_date(day, {AS_OF_YEAR}) AS ordered,
               csv_bool(word) AS flag, csv_us_state(state) AS state, csv_error_code(reason) AS code
        FROM messy""")


@query("""
    SELECT 'archive' AS step, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-21' GROUP BY event_type
    UNION ALL SELECT 'purge', event_type, count(*) FROM events WHERE ts < TIMESTAMP '2024-01-06' GROUP BY event_type""")
def sql_retention(spark, sf):
    """What the archive and the purge would take, asked in SQL."""
    entries = table(spark, sf, "events").select(F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("created_at"))
    entries.createOrReplaceTempView("audit_log")
    entries.createOrReplaceTempView("audit_log_archive")
    sql.register(spark)
    return spark.sql("""
        SELECT 'archive' AS step, action AS event_type, count(*) AS n FROM csv_archive_due(TIMESTAMP '2024-03-21', 60) GROUP BY action
        UNION ALL SELECT 'purge', action, count(*) FROM csv_purge_due(TIMESTAMP '2030-01-06', 6) GROUP BY action""")
