"""Search, filters, sorts, pages and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from csvharbor.operators import filters, views
from csvharbor.operators.filters import Filter
from csvharbor.workload.base import CUSTOMER, LINEITEM, ORDERS, PART, double, query, table


@query("SELECT * FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET 50")
def table_page(spark, sf):
    orders = table(spark, sf, "orders")
    return views.page_rows(orders, views.ordering([("o_totalprice", "desc")], ORDERS), 3)


@query("SELECT * FROM orders ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25")
def two_level_sort_page(spark, sf):
    sorts = views.parse_sorts("O_OrderPriority,o_totalprice,o_custkey", "up,desc")
    return views.page_rows(table(spark, sf, "orders"), views.ordering(sorts, ORDERS), 1)


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 25")
def default_sort_page(spark, sf):
    return views.page_rows(table(spark, sf, "customer"), views.ordering([("unknown", "desc")], CUSTOMER), -4)


@query(
    "WITH n AS (SELECT count(*) AS c FROM customer) SELECT * FROM customer ORDER BY c_custkey LIMIT 25"
    " OFFSET (SELECT greatest((c + 24) // 25 - 1, 0) * 25 FROM n)"
)
def page_past_the_end(spark, sf):
    return views.page_rows(table(spark, sf, "customer"), views.ordering([], CUSTOMER), 1_000_000)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25 OFFSET (SELECT count(*) // 2 FROM orders)")
def deep_page(spark, sf):
    """A page in the middle of the table, by the way taken where the rows before it are too many for one task."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return views.slice_rows(orders, views.ordering([("o_totalprice", "desc")], ORDERS), orders.count() // 2, 25, deep=100)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_orderkey, l_linenumber) > (200, 3) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25")
def next_page_by_key(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return views.page_after(table(spark, sf, "lineitem").select(order), order, [200, 3, 1 << 60, 1 << 60])


PRICEY = [Filter("o_totalprice", "gte", "200000")]


@query("""
    SELECT count(*) AS total_rows, greatest((count(*) + 24) // 25, 1) AS total_pages,
           least(3, greatest((count(*) + 24) // 25, 1)) AS page,
           'o_totalprice gte:200000' AS active_filters, 'o_totalprice desc' AS sorts
    FROM orders WHERE o_totalprice >= 200000""")
def page_metadata(spark, sf):
    rows = views.view(table(spark, sf, "orders"), ORDERS, filters=PRICEY)
    return views.page_metadata(rows, ORDERS, 3, sorts=[("o_totalprice", "desc")], filters=PRICEY)


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice >= 200000 AND o_orderpriority ILIKE '%high%'")
def filtered_count(spark, sf):
    both = [*PRICEY, Filter("o_orderpriority", "contains", "high")]
    return views.view(table(spark, sf, "orders"), ORDERS, filters=both).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RiNg%' OR p_brand ILIKE '%RiNg%' OR p_type ILIKE '%RiNg%'")
def global_search(spark, sf):
    return filters.search(table(spark, sf, "part"), "RiNg", PART).select("p_partkey", "p_name")


@query("SELECT count(*) AS wild, (SELECT count(*) FROM part WHERE contains(p_brand, 'd_')) AS literal FROM part WHERE p_brand ILIKE '%d_1%'")
def search_wildcards(spark, sf):
    part = table(spark, sf, "part")
    wild = filters.apply_filters(part, [Filter("p_brand", "contains", "d_1")]).agg(F.count("*").alias("n"))
    literal = filters.apply_filters(part, [Filter("p_brand", "contains", "d_", literal=True)]).agg(F.count("*").alias("n"))
    both = wild.select("n", F.lit(0).alias("l")).unionAll(literal.select(F.lit(0), "n"))
    return both.agg(F.sum("n").alias("wild"), F.sum("l").alias("literal"))


def one_filter(name: str, of: str, column: str, op: str, value: str, key: str, condition: str) -> None:
    @query(f"SELECT {key}, {column} FROM {of} WHERE {condition}", name)
    def run(spark, sf):
        return filters.apply_filters(table(spark, sf, of), [Filter(column, op, value)]).select(key, column)


one_filter("filter_contains", "customer", "c_mktsegment", "contains", "ild", "c_custkey", "c_mktsegment ILIKE '%ild%'")
one_filter("filter_eq", "orders", "o_orderstatus", "eq", "F", "o_orderkey", "o_orderstatus = 'F'")
one_filter("filter_starts", "part", "p_name", "starts", "RED", "p_partkey", "p_name ILIKE 'red%'")
one_filter("filter_ends", "part", "p_name", "ends", "Bolt", "p_partkey", "p_name ILIKE '%bolt'")
one_filter("filter_gte", "customer", "c_acctbal", "gte", "5000.50", "c_custkey", "c_acctbal >= 5000.50")
one_filter("filter_lte", "customer", "c_acctbal", "lte", "0", "c_custkey", "c_acctbal <= 0")
one_filter("filter_gt", "part", "p_size", "gt", "40", "p_partkey", "p_size > 40")
one_filter("filter_lt", "orders", "o_orderdate", "lt", "1996-01-01", "o_orderkey", "o_orderdate < TIMESTAMP '1996-01-01'")
one_filter("filter_in", "orders", "o_orderpriority", "in", "1-URGENT, 5-LOW ,none", "o_orderkey", "o_orderpriority IN ('1-URGENT', '5-LOW')")
one_filter("filter_unknown_operator", "customer", "c_name", "like", "x", "c_custkey", "true")


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
    WHERE l_quantity BETWEEN 10 AND 20 AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-12-31'
      AND l_returnflag ILIKE '%r%'""")
def filter_and_range(spark, sf):
    ranges = [
        *filters.between("l_quantity", "10", "20"),
        *filters.between("l_shipdate", "1996-01-01", "1996-12-31"),
        *filters.between("l_tax", None, None),
        Filter("l_returnflag", "contains", "r"),
    ]
    rows = filters.apply_filters(table(spark, sf, "lineitem"), ranges)
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("""
    SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
    WHERE o_totalprice >= 100000 AND o_totalprice < 150000 AND o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1997-01-01'""")
def filter_request(spark, sf):
    request = {
        "filter[O_TOTALPRICE]": ["gte:100000", "lt:150000", "contains:9", "gt:"],
        "filter[o_orderstatus]": ["eq:O", "gte:A"],
        "filter[o_orderdate]": ["gte:1997-01-01", "lt:1990-01-01", "broken"],
        "filter[nothing]": ["eq:1"],
        "page": ["2"],
    }
    rows = filters.apply_filters(table(spark, sf, "orders"), filters.parse_filters(request, ORDERS))
    return rows.select("o_orderkey", "o_totalprice", "o_orderdate")


HIGH_OPEN = views.SavedView(
    ORDERS, "high", (Filter("o_orderstatus", "eq", "O"),), (("o_orderdate", "desc"), ("o_totalprice", "asc")),
    ("o_orderkey", "o_orderdate", "o_totalprice"),
)


@query("""
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
    WHERE (o_orderstatus ILIKE '%high%' OR o_orderpriority ILIKE '%high%') AND o_orderstatus = 'O'""")
def saved_view(spark, sf):
    return HIGH_OPEN.apply(table(spark, sf, "orders"))


PROFILED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) AS sum,
        round(CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / count({c}), 6) AS avg,
        CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, count({c}) AS count
        FROM lineitem WHERE l_quantity >= 10 AND l_returnflag ILIKE '%r%'"""
    for c in PROFILED
)


@query(PROFILE_SQL)
def column_profile(spark, sf):
    chosen = [Filter("l_quantity", "gte", "10"), Filter("l_returnflag", "contains", "R")]
    profile = views.column_profile(views.view(table(spark, sf, "lineitem"), LINEITEM, filters=chosen), LINEITEM)
    return profile.select("column_name", double("sum").alias("sum"), F.round(double("avg"), 6).alias("avg"), double("min").alias("min"), double("max").alias("max"), "count")


@query("""
    SELECT 'p_size' AS column_name, CAST(NULL AS DOUBLE) AS sum, count(*) AS count FROM part WHERE p_name = 'no such part'
    UNION ALL SELECT 'p_partkey', NULL, 0 UNION ALL SELECT 'p_retailprice', NULL, 0""")
def column_profile_of_nothing(spark, sf):
    none = filters.apply_filters(table(spark, sf, "part"), [Filter("p_name", "eq", "no such part")])
    return views.column_profile(none, PART).select("column_name", double("sum").alias("sum"), "count")
