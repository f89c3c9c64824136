"""Row checks over orders rendered as text, broken at known places."""

from __future__ import annotations

from pyspark.sql import functions as F

from csvharbor.functions import messages
from csvharbor.functions.cells import clean_cell
from csvharbor.operators import validate
from csvharbor.sources import headers
from csvharbor.specs import FieldSpec, FieldType, TableSpec
from csvharbor.workload.base import AS_OF_YEAR, query, table

FORM = TableSpec(
    "order_form", "Sales", "Order form", "OrderForm", ("order",),
    (
        FieldSpec("order", required=True, allow_empty=False),
        FieldSpec("status", FieldType.ENUM, required=True, enum_values=("o", "F", "P")),
        FieldSpec("price", FieldType.NUMERIC, required=True),
        FieldSpec("ordered", FieldType.DATE, required=True),
        FieldSpec("urgent", FieldType.BOOL),
    ),
)
BROKEN = {"order": 23, "status": 17, "price": 13, "ordered": 19, "urgent": 29}
WRONG_TEXT = {"order": "", "status": "X", "price": "12x", "ordered": "never", "urgent": "maybe"}


def forms(spark, sf):
    """Cells per order; some are wrong, and in one row of 31 the status column is missing."""
    key = F.col("o_orderkey")
    good = {
        "order": F.format_string('="%d"', key),
        "status": F.col("o_orderstatus"),
        "price": F.concat(F.lit("$"), F.format_number("o_totalprice", 2)),
        "ordered": F.date_format("o_orderdate", "M/d/yyyy"),
        "urgent": F.when(F.col("o_orderpriority") == "1-URGENT", "Yes").otherwise("No"),
    }
    cells = [clean_cell(F.when(key % BROKEN[n] == 0, WRONG_TEXT[n]).otherwise(c)).alias(n) for n, c in good.items()]
    rows = table(spark, sf, "orders").select("o_orderkey", *cells)
    return rows.withColumn("status", F.when(key % 31 != 0, F.col("status")))



def cells_of_form():
    return {f.name: F.col(f"`{f.name}`") for f in FORM.fields}


K = "o_orderkey"
ERROR_SQL = {
    "order": ("'required field is empty'", "''"),
    "status": ("'value must be one of: o, F, P'", "'X'"),
    "price": ("'invalid number format'", "'12x'"),
    "ordered": ("'invalid date format (use YYYY-MM-DD or similar)'", "'never'"),
    "urgent": ("'must be yes/no, true/false, or 1/0'", "'maybe'"),
}
REASON_SQL = {
    "order": """'empty required field "order"'""",
    "status": """'invalid enum for "status": "X"'""",
    "price": """'invalid numeric for "price": "12x"'""",
    "ordered": """'invalid date for "ordered": "never"'""",
}
MISSING_SQL = """'missing required column "status"'"""


def when_sql(name: str) -> str:
    return f"{K} % {BROKEN[name]} = 0" + (f" AND {K} % 31 <> 0" if name == "status" else "")


@query(
    " UNION ALL ".join(f"SELECT {K}, '{n}' AS field, {v} AS value, {m} AS message FROM orders WHERE {when_sql(n)}" for n, (m, v) in ERROR_SQL.items())
    + f" UNION ALL SELECT {K}, 'status', '', 'missing required column' FROM orders WHERE {K} % 31 = 0"
)
def row_errors_all(spark, sf):
    rows, typed = validate.with_values(forms(spark, sf), cells_of_form(), FORM.fields, AS_OF_YEAR)
    checked = rows.withColumn("errors", validate.row_errors(cells_of_form(), FORM.fields, AS_OF_YEAR, typed))
    return validate.error_table(checked, "errors", K)


FIRST_SQL = "CASE " + " ".join(
    (f"WHEN {K} % 31 = 0 THEN {MISSING_SQL} " if n == "status" else "") + f"WHEN {when_sql(n)} THEN {r}" for n, r in REASON_SQL.items()
) + " END"


@query(f"SELECT {K}, {FIRST_SQL} AS reason FROM orders")
def first_error(spark, sf):
    rows, typed = validate.with_values(forms(spark, sf), cells_of_form(), FORM.fields, AS_OF_YEAR)
    return rows.select(K, validate.first_reason(cells_of_form(), FORM.fields, AS_OF_YEAR, typed=typed).alias("reason"))


@query(f"""SELECT {K}, coalesce({FIRST_SQL}, CASE WHEN {when_sql('urgent')} THEN 'invalid bool for "urgent": "maybe"' END) AS reason FROM orders""")
def first_error_strict(spark, sf):
    return forms(spark, sf).select(K, validate.first_reason(cells_of_form(), FORM.fields, AS_OF_YEAR, strict=True).alias("reason"))


ALL_SQL = "concat_ws('; ', " + ", ".join(
    (f"CASE WHEN {K} % 31 = 0 THEN {MISSING_SQL} END, " if n == "status" else "") + f"CASE WHEN {when_sql(n)} THEN {r} END" for n, r in REASON_SQL.items()
) + ")"


@query(f"SELECT {K}, {ALL_SQL} AS reasons FROM orders")
def preview_errors(spark, sf):
    rows, typed = validate.with_values(forms(spark, sf), cells_of_form(), FORM.fields, AS_OF_YEAR)
    return rows.select(K, validate.reason_text(cells_of_form(), FORM.fields, AS_OF_YEAR, typed=typed).alias("reasons"))


@query(f"""
    SELECT outcome, coalesce(code, '') AS code, count(*) AS n FROM
      (SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'failed' END AS outcome,
              CASE WHEN reason IS NULL THEN NULL WHEN contains(reason, 'invalid date') THEN 'VAL001' WHEN contains(reason, 'required field') THEN 'VAL003'
                   WHEN contains(reason, 'missing required column') THEN 'VAL004' WHEN contains(reason, 'invalid enum') THEN 'VAL006' ELSE 'ERR000' END AS code
       FROM (SELECT {FIRST_SQL} AS reason FROM orders)) GROUP BY ALL""")
def quarantine_split(spark, sf):
    judged = forms(spark, sf).withColumn("reason", validate.first_reason(cells_of_form(), FORM.fields, AS_OF_YEAR))
    outcome = F.when(F.col("reason").isNull(), "accepted").otherwise("failed")
    code = F.coalesce(messages.error_code(F.col("reason")), F.lit(""))
    return judged.groupBy(outcome.alias("outcome"), code.alias("code")).agg(F.count("*").alias("n"))


@query("""
    SELECT event_id, 'action not allowed: ' || event_type AS reason FROM events WHERE event_type <> 'click' AND event_id % 2 = 0
    UNION ALL SELECT event_id, 'severity not allowed: NULL' FROM events WHERE (event_type = 'click' OR event_id % 2 = 1) AND event_id % 7 = 0""")
def domain_checks(spark, sf):
    action = F.when((F.col("event_type") == "click") | (F.col("event_id") % 2 == 1), "upload").otherwise(F.col("event_type"))
    level = F.when(F.col("event_id") % 7 != 0, "high")
    rows = table(spark, sf, "events").select("event_id", action.alias("action"), level.alias("severity"))
    return validate.split_by_domain(rows, validate.AUDIT_DOMAINS)[1].select("event_id", "reason")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def unique_append(spark, sf):
    customers = table(spark, sf, "customer")
    taken = customers.filter("c_custkey % 3 <> 0").select("c_nationkey", "c_name")
    return validate.not_yet_present(customers.select("c_custkey", "c_nationkey", "c_name"), taken, ["c_nationkey", "c_name"]).select("c_custkey")


@query("""
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'missing required columns: price' WHEN 2 THEN 'missing required columns: order, price, ordered'
           END AS error, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN -1 ELSE 4 END AS ordered_at
    FROM orders""")
def required_headers(spark, sf):
    """One header per order: complete, without price, with unknown names only, with a repeated name (the last one counts)."""
    shapes = (["order", "STATUS", ' "price" ', '="Ordered"'], ["order", "status", "x", "ordered"], ["a", "status"], ["order", "status", "ordered", "price", "ordered"])
    chosen = F.when(F.lit(False), F.array().cast("array<string>"))
    for i, shape in enumerate(shapes):
        chosen = chosen.when(F.col(K) % 4 == i, F.array(*[F.lit(h) for h in shape]))
    files = table(spark, sf, "orders").select(K, chosen.alias("header"))
    at = F.try_element_at(headers.header_index(F.col("header")), F.lit("ordered"))
    return files.select(K, headers.missing_columns_error(F.col("header"), FORM.fields).alias("error"), F.coalesce(at, F.lit(-1)).alias("ordered_at"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2,,0,,' ELSE '1,2,0,,' END AS positions FROM orders""")
def mapped_headers(spark, sf):
    """An explicit mapping; positions outside the header count for nothing."""
    wide = F.array(*[F.lit(h) for h in ("a", "b", "c")])
    name = F.when(F.col(K) % 3 == 0, F.create_map(F.lit("Order"), F.lit(2), F.lit("status"), F.lit(7), F.lit("price"), F.lit(0), F.lit("ordered"), F.lit(-1)))
    given = name.otherwise(F.create_map(F.lit("order"), F.lit(1), F.lit("Status"), F.lit(2), F.lit("price"), F.lit(0), F.lit("urgent"), F.lit(3)))
    rows = table(spark, sf, "orders").select(K, headers.mapped_index(given, wide).alias("index"))
    at = headers.positions(F.col("index"), FORM)
    return rows.select(K, F.array_join(F.transform(at, lambda p: p.cast("string")), ",", "").alias("positions"))


@query("""
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'expected 5 columns, got 2' END AS reason, o_orderkey % 5 = 0 AS blank FROM orders""")
def record_shape(spark, sf):
    from csvharbor.sources.records import blank_record

    wide = F.array(*[F.lit(str(i)) for i in range(6)])
    tokens = F.when(F.col(K) % 3 == 0, wide).when(F.col(K) % 3 == 1, F.slice(wide, 1, 2)).otherwise(F.slice(wide, 1, 5))
    blank = F.when(F.col(K) % 5 == 0, F.transform(tokens, lambda t: F.lit(" \t"))).otherwise(tokens)
    return table(spark, sf, "orders").select(K, validate.width_reason(tokens, 5).alias("reason"), blank_record(blank).alias("blank"))
