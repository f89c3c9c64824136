"""Specs, the shipped tables, and what the driver side decides: filters, sorts, pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from csvharbor.functions import formats, messages
from csvharbor.operators import filters, validate, views
from csvharbor.operators.audit import AUDIT_SCHEMA
from csvharbor.shipped import shipped_registry
from csvharbor.specs import FieldSpec, FieldType, TableSpec, column_name


def test_shipped_tables():
    registry = shipped_registry()
    assert [(s.key, len(s.fields)) for s in registry.all()] == [
        ("anrok_transactions", 23), ("ns_customers", 9), ("ns_invoice_detail", 22), ("ns_so_detail", 17),
        ("sfdc_customers", 4), ("sfdc_opp_detail", 26), ("sfdc_price_book", 5),
    ]
    assert registry.groups() == ["Anrok", "NS", "SFDC"] and len(registry) == 7
    assert [s.key for s in registry.by_group("SFDC")] == ["sfdc_customers", "sfdc_opp_detail", "sfdc_price_book"]
    anrok, opp = registry.get("anrok_transactions"), registry.get("sfdc_opp_detail")
    assert anrok.resolve("transaction id") == "transaction_id" and anrok.resolve("EXEMPT REASONS") == "exempt_reason"
    assert anrok.key_columns == ["transaction_id"] and anrok.resolve("No Such Column") == "no_such_column"
    kinds = [len(opp.of_type(k)) for k in (FieldType.NUMERIC, FieldType.DATE, FieldType.BOOL)]
    assert kinds == [9, 6, 1]
    assert registry.get("ns_invoice_detail").field("shipping_address_state").normalizer is not None
    assert registry.get("ns_so_detail").field("customer_project").not_null
    assert not any(f.required or not f.allow_empty for s in registry.all() for f in s.fields)
    with pytest.raises(ValueError, match="already registered"):
        registry.register(anrok)
    with pytest.raises(KeyError):
        registry.get("nope")


def test_catalog_and_display(spark):
    rows = shipped_registry().catalog(spark).collect()
    assert [r.key for r in rows][:2] == ["anrok_transactions", "ns_customers"] and rows[3].unique_key == ["sfdc_opp_id", "sfdc_opp_line_id"]
    anrok = shipped_registry().get("anrok_transactions")
    shown = anrok.display(spark.createDataFrame([], anrok.schema()))
    assert shown.columns == anrok.names and len(AUDIT_SCHEMA.fields) == 20


def test_column_names():
    assert column_name("Transaction ID") == "transaction_id" and column_name("snake_case") == "snake_case"


PEOPLE = TableSpec(
    "people", "T", "P", "P", ("full_name",),
    (FieldSpec("full_name"), FieldSpec("Email", db_column="email_addr"), FieldSpec("age", FieldType.NUMERIC), FieldSpec("born", FieldType.DATE),
     FieldSpec("on", FieldType.BOOL), FieldSpec("kind", FieldType.ENUM, enum_values=("a", "b"))),
)


def test_operators_allowed():
    allowed = {t: [op for op in ("contains", "eq", "starts", "ends", "gte", "lte", "gt", "lt", "in", "x") if filters.is_allowed(op, t)] for t in FieldType}
    assert allowed[FieldType.TEXT] == ["contains", "eq", "starts", "ends"]
    assert allowed[FieldType.NUMERIC] == ["eq", "gte", "lte", "gt", "lt"]
    assert allowed[FieldType.DATE] == ["eq", "gte", "lte"]
    assert allowed[FieldType.BOOL] == ["eq"] and allowed[FieldType.ENUM] == ["eq", "in"]


def test_filter_requests():
    request = {"filter[EMAIL]": ["contains:a:b", "gt:x"], "filter[age]": ["gte:1", "lte:"], "filter[]": ["eq:1"], "x": ["eq:1"], "filter[zip]": ["eq:1"]}
    parsed = filters.parse_filters(request, PEOPLE)
    assert [(f.column, f.op, f.value) for f in parsed] == [("email_addr", "contains", "a:b"), ("age", "gte", "1")]


def test_unknown_operator(spark):
    df = spark.createDataFrame([("x",)], "full_name string")
    assert filters.apply_filters(df, [filters.Filter("full_name", "like", "y")]).count() == 1
    with pytest.raises(ValueError, match="unknown operator"):
        filters.apply_filters(df, [filters.Filter("full_name", "like", "y")], strict=True)


def test_sorts_and_pages():
    assert views.parse_sorts("a, b,c", "desc,up") == [("a", "desc"), ("b", "asc")] and views.parse_sorts("") == []
    assert views.effective_sorts([("AGE", "DESC"), ("zip", "asc"), ("born", "x"), ("on", "asc")], PEOPLE) == [("age", "desc"), ("born", "asc")]
    assert views.effective_sorts([], PEOPLE) == [("full_name", "asc")]
    infos = [views.page_info(n, p, 25) for n, p in ((0, 3), (25, 2), (26, 2), (26, 9), (100, -1))]
    assert [(i.total_pages, i.page, i.offset) for i in infos] == [(1, 1, 0), (1, 1, 0), (2, 2, 25), (2, 2, 25), (4, 1, 0)]


def test_null_order(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "full_name string, age int")
    up = [r.full_name for r in df.orderBy(*views.ordering([("age", "asc")], PEOPLE)).collect()]
    down = [r.full_name for r in df.orderBy(*views.ordering([("age", "desc")], PEOPLE)).collect()]
    assert up == ["a", "c", "b"] and down == ["b", "c", "a"]


@pytest.mark.parametrize("offset", [0, 99, 100, 101, 2500, 4990, 5000, 9999])
def test_deep_slices_match_plain_ones(spark, offset):
    # Half of the rows are equal in the sort column; rows 4999.. of the order are one value.
    df = spark.range(0, 5005).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), "id").repartition(5)
    order = [F.col("k").desc(), F.col("id").asc()]
    deep = views.slice_rows(df, order, offset, 25, deep=-1).collect()
    assert deep == df.orderBy(*order).offset(offset).limit(25).collect()


def test_empty_profile(spark):
    text_only = TableSpec("t", "T", "T", "T", ("a",), (FieldSpec("a"),))
    assert views.column_profile(spark.createDataFrame([("x",)], "a string"), text_only).count() == 0


def test_time_bounds(spark):
    as_of = dt.datetime(2026, 6, 1)
    moments = [dt.datetime(1969, 12, 31), dt.datetime(1970, 1, 1), dt.datetime(2026, 6, 2), dt.datetime(2026, 6, 2, 0, 0, 1)]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    assert filters.in_time_range(df, "t", as_of).count() == 2
    assert filters.end_of_day(dt.date(2024, 2, 29)) == dt.datetime(2024, 2, 29, 23, 59, 59)
    years = spark.createDataFrame([(dt.datetime(2024, 2, 27, 23),), (dt.datetime(2024, 2, 28),)], "t timestamp_ntz")
    assert years.filter(filters.older_than(years, "t", dt.datetime(2026, 2, 28), years=2)).count() == 1


def test_error_codes(spark):
    cases = {
        "pq: duplicate key value violates unique constraint": "DB001", "ERROR: unique constraint violated": "DB002",
        "violates foreign key constraint": "DB003", "dial tcp: connection refused": "DB004", "context deadline exceeded (timeout)": "DB006",
        "file too large: 200MB exceeds limit": "FILE001", "rate limit exceeded": "RATE001", "some random internal error": "ERR000",
        'invalid numeric for "a": "x"': "ERR000", "expected 3 columns, got 1": "ERR000", 'empty required field "a"': "VAL003",
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    got = {r.t: (r.c, r.s, r.k) for r in df.select("t", messages.error_code(F.col("t")).alias("c"), messages.error_text(F.col("t")).alias("s"), messages.is_known_error(F.col("t")).alias("k")).collect()}
    assert {t: v[0] for t, v in got.items() if t} == cases and got[None] == (None, "", False)
    assert got["rate limit exceeded"][1] == "Too many requests (Code: RATE001). Please wait a moment before trying again"
    assert not got["some random internal error"][2] and len(messages.ERROR_PATTERNS) == 28


def test_cell_messages(spark):
    by_name = {"age": "12x", "born": "soon", "on": "maybe", "kind": "z", "full_name": "any"}
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in by_name.items()])
    shown = row.select(*[validate.cell_error(F.col(f"`{n}`"), PEOPLE.field(n), 2026).alias(n) for n in by_name]).first().asDict()
    assert shown == {
        "age": "invalid number format", "born": "invalid date format (use YYYY-MM-DD or similar)", "on": "must be yes/no, true/false, or 1/0",
        "kind": "value must be one of: a, b", "full_name": None,
    }
    quoted = spark.range(1).select(formats.escaped_text(F.lit('a"b\\c\n')).alias("q")).first().q
    assert quoted == '"a\\"b\\\\c\\n"'
