"""Cell functions: known values are rendered as messy text, cleaning must give them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from csvharbor.functions import cells, formats, messages
from csvharbor.operators import mapping
from csvharbor.operators.validate import tally_by_code
from csvharbor.plans.ingest import typed_columns
from csvharbor.specs import FieldType
from csvharbor.workload.base import AS_OF_YEAR, CUSTOMER, double, pick, query, spec, table


def key():
    return F.col("o_orderkey")


def wrapped(c, number):
    """Spreadsheet wrappers that cleaning removes."""
    around = [("", ""), ('="', '"'), ("=", ""), ('"', '"'), ("'", ""), ("netsuite:", ""), ("  ", "\t"), (' ="', '" '), ('="netsuite:', '"')]
    return pick(number, *[F.concat(F.lit(a), c, F.lit(b)) for a, b in around])


@query("SELECT o_orderkey, o_orderpriority AS cleaned FROM orders")
def clean_cells(spark, sf):
    cell = wrapped(F.col("o_orderpriority"), key())
    return table(spark, sf, "orders").select("o_orderkey", cells.clean_cell(cell).alias("cleaned"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderpriority END AS parsed FROM orders")
def parse_text(spark, sf):
    p = F.col("o_orderpriority")
    text = pick(key(), p, F.lit(" \t "), F.concat(F.lit("  "), p), F.concat(p, F.lit(" \n")))
    return table(spark, sf, "orders").select("o_orderkey", cells.to_text(text).alias("parsed"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 12 IN (1, 7) THEN -o_totalprice WHEN o_orderkey % 12 <> 6 AND o_orderkey % 12 < 10 THEN o_totalprice END AS parsed,
           o_orderkey % 12 >= 10 AS too_long FROM orders""")
def parse_numeric(spark, sf):
    price = F.col("o_totalprice")
    commas, plain = F.format_number(price, 2), price.cast("decimal(18,2)").cast("string")
    text = pick(
        key(), F.concat(F.lit("$"), commas), F.concat(F.lit("($ "), commas, F.lit(")")), F.concat(F.lit(" +"), plain, F.lit(" ")),
        F.concat(F.lit("€"), commas), plain, F.concat(F.lit("£"), plain, F.lit("000")), F.concat(plain, F.lit("e1")),
        F.concat(F.lit("-$"), plain), F.concat(plain, F.lit("$")), F.concat(F.lit("+$"), plain),
        F.concat(F.lit("91234567890123456789"), plain), F.concat(plain, F.lit("0000000003")),
    )
    parsed = F.when(~cells.number_too_long(text), cells.to_numeric(text))
    return table(spark, sf, "orders").select("o_orderkey", double(parsed).alias("parsed"), cells.number_too_long(text).alias("too_long"))


DATE_FORMATS = ("M/d/yyyy", "MM-dd-yyyy", "yyyy-MM-dd", "MMM d, yyyy", "yyyyMMdd", "M.d.yy", "d MMM yyyy", "yyyy/MM/dd", "M/dd/yy")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 9 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders")
def parse_date(spark, sf):
    shapes = [F.date_format("o_orderdate", f) for f in DATE_FORMATS]
    text = F.concat(F.lit(" "), pick(key(), *shapes, F.date_format("o_orderdate", "yyyy-13-dd")))
    return table(spark, sf, "orders").select("o_orderkey", cells.to_date(text, AS_OF_YEAR).alias("parsed"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 < 5 THEN true WHEN o_orderkey % 11 < 10 THEN false END AS parsed FROM orders""")
def parse_bool(spark, sf):
    words = [w.upper() if i % 2 else f" {w}" for i, w in enumerate(cells.TRUE_WORDS + cells.FALSE_WORDS)]
    text = pick(key(), *[F.lit(w) for w in words], F.lit("maybe"))
    return table(spark, sf, "orders").select("o_orderkey", cells.to_bool(text).alias("parsed"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
           || substr(h, 17, 4) || '-' || substr(h, 21) ELSE '' END AS parsed
    FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)""")
def parse_uuid(spark, sf):
    digits = F.md5(key().cast("string"))
    dashed = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    text = pick(key(), dashed, F.upper(dashed), F.concat(F.lit("{"), dashed, F.lit("}")), digits, F.substring(dashed, 1, 30))
    return table(spark, sf, "orders").select("o_orderkey", cells.uuid_text(cells.to_uuid(text)).alias("parsed"))


@query("SELECT o_orderkey, nullif(CAST(o_custkey % 4 AS INTEGER), 0) AS n FROM orders")
def zero_to_null(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", cells.zero_to_null((F.col("o_custkey") % 4).cast("int")).alias("n"))


STATES = list(cells.US_STATES.items())


@query(f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'Ontario' ELSE list_extract({[s[1] for s in STATES]}, CAST(o_custkey % 50 + 1 AS INTEGER)) END AS state
    FROM orders""")
def us_state(spark, sf):
    at = (F.col("o_custkey") % 50).cast("int")
    name, code = (F.get(F.array(*[F.lit(s[i]) for s in STATES]), at) for i in (0, 1))
    text = pick(key(), F.initcap(name), F.concat(F.lit(" "), F.upper(name)), F.lower(code), F.lit(" Ontario "))
    return table(spark, sf, "orders").select("o_orderkey", cells.normalize_us_state(text).alias("state"))


TWO = "CASE WHEN {0} = floor({0}) THEN printf('%.0f', {0}) ELSE printf('%.2f', {0}) END"
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {TWO.format('l_extendedprice')} AS price, {TWO.format('l_discount')} AS discount,
           strftime(l_shipdate, '%Y-%m-%d') AS shipped, CASE WHEN l_returnflag = 'N' THEN '' WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS returned
    FROM lineitem""")
def format_export(spark, sf):
    returned = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R")
    return table(spark, sf, "lineitem").select(
        *LINE,
        formats.export_value(F.col("l_extendedprice"), FieldType.NUMERIC).alias("price"),
        formats.export_value(F.col("l_discount"), FieldType.NUMERIC).alias("discount"),
        formats.export_value(F.col("l_shipdate"), FieldType.DATE).alias("shipped"),
        formats.export_value(returned, FieldType.BOOL).alias("returned"),
    )


@query(r"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_replace(printf('%.2f', l_extendedprice), '\.?0+$', '') AS price,
           regexp_replace(printf('%.2f', l_quantity * 10), '\.?0+$', '') AS quantity, CASE WHEN l_tax > 0 THEN regexp_replace(printf('%.2f', l_tax), '\.?0+$', '') ELSE '' END AS tax
    FROM lineitem""")
def format_preview(spark, sf):
    tax = F.when(F.col("l_tax") > 0, F.col("l_tax"))
    return table(spark, sf, "lineitem").select(
        *LINE,
        formats.preview_value(F.col("l_extendedprice"), FieldType.NUMERIC).alias("price"),
        formats.preview_value(F.col("l_quantity") * 10, FieldType.NUMERIC).alias("quantity"),
        formats.preview_value(tax, FieldType.NUMERIC).alias("tax"),
    )


@query(r"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity,
           regexp_replace(printf('%.2f', l_discount), '\.?0+$', '') AS discount, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE '' END AS flag
    FROM lineitem""")
def format_key(spark, sf):
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return table(spark, sf, "lineitem").select(
        *LINE,
        formats.key_value(F.col("l_quantity"), FieldType.NUMERIC).alias("quantity"),
        formats.key_value(F.col("l_discount"), FieldType.NUMERIC).alias("discount"),
        formats.key_value(flag, FieldType.TEXT).alias("flag"),
    )


RECORD = spec("record", "order", "order:numeric status total:numeric ordered:date urgent:bool note")


@query("""
    SELECT CAST(o_orderkey AS DOUBLE) AS "order", o_orderstatus AS status, o_totalprice AS total, CAST(o_orderdate AS DATE) AS ordered,
           o_orderpriority = '1-URGENT' AS urgent, CAST(NULL AS VARCHAR) AS note
    FROM orders""")
def typed_projection(spark, sf):
    """A record of texts to the table's typed columns; the last column is missing from the record."""
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "YES").otherwise(" n ")
    tokens = F.array(
        F.format_string('="%d"', key()), wrapped(F.col("o_orderstatus"), key()), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)),
        F.date_format("o_orderdate", "M/d/yyyy"), urgent,
    )
    rows = table(spark, sf, "orders").select(F.transform(tokens, cells.clean_cell).alias("cells"))
    by_name = {f.name: F.get("cells", F.lit(i)) for i, f in enumerate(RECORD.fields)}
    typed = rows.select(*typed_columns(by_name, RECORD, AS_OF_YEAR))
    return typed.withColumns({"order": double("order"), "total": double("total")})


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'name,segment' ELSE 'name' END AS names,
           CASE WHEN c_custkey % 3 = 0 THEN c_name || ',' || c_mktsegment ELSE c_name END AS cleaned
    FROM customer""")
def row_to_map(spark, sf):
    segment = F.when(F.col("c_custkey") % 3 == 0, cells.clean_cell(wrapped(F.col("c_mktsegment"), F.col("c_custkey"))))
    values = formats.value_map({"name": F.col("c_name"), "segment": segment})
    rows = table(spark, sf, "customer").select("c_custkey", values.alias("v"))
    return rows.select("c_custkey", F.array_join(F.map_keys("v"), ",").alias("names"), F.array_join(F.map_values("v"), ",").alias("cleaned"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def row_json(spark, sf):
    """A stored row to JSON, as the audit log keeps it, and back."""
    rows = table(spark, sf, "customer")
    return rows.select(formats.row_json(CUSTOMER.fields).alias("j")).select(F.from_json("j", rows.schema).alias("r")).select("r.*")


@query("""
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.7' WHEN 1 THEN '192.168.1.' || CAST(user_id % 256 AS VARCHAR)
           WHEN 2 THEN '2001:db8::' || CAST(user_id % 1000 AS VARCHAR) END AS host
    FROM events""")
def ip_host(spark, sf):
    user = F.col("user_id")
    text = pick(
        F.col("event_id"),
        F.concat(F.lit("10.0."), (user % 256).cast("string"), F.lit(".7:8080")),
        F.concat(F.lit("192.168.1."), (user % 256).cast("string")),
        F.concat(F.lit("[2001:db8::"), (user % 1000).cast("string"), F.lit("]:443")),
        F.concat(F.lit("300.1.1."), user.cast("string")),
        F.col("event_type"),
    )
    return table(spark, sf, "events").select("event_id", cells.ip_host(text).alias("host"))


@query("""
    SELECT doc_id, md5(field) AS field_md5, CAST(length(field) AS INTEGER) AS field_length FROM
      (SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents)""")
def csv_field(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", formats.csv_field(F.col("text")).alias("field"))
    return rows.select("doc_id", F.md5("field").alias("field_md5"), F.length("field").alias("field_length"))


@query("SELECT doc_id, md5('?' || text || '??') AS marked_md5, md5(chr(65533) || text || chr(65533) || chr(65533)) AS replaced_md5 FROM documents")
def repair_bytes(spark, sf):
    """Whole texts between a stray continuation byte and a cut-off three-byte character."""
    broken = F.concat(F.unhex(F.lit("80")), F.encode("text", "UTF-8"), F.unhex(F.lit("E282"))).cast("string")
    rows = table(spark, sf, "documents").select("doc_id", broken.alias("b"))
    return rows.select("doc_id", F.md5(cells.repair_utf8(F.col("b"), "?")).alias("marked_md5"), F.md5(cells.repair_utf8(F.col("b"))).alias("replaced_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def strip_bom(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(cells.strip_bom(F.concat(F.lit("\ufeff"), F.col("text")))).alias("text_md5"))


ACTION_OF = {"click": "upload", "view": "cell_edit", "purchase": "table_reset", "signup": "template_update", "error": "row_delete"}
SEVERITY_OF = {"click": "high", "view": "medium", "purchase": "critical", "signup": "low", "error": "high"}


def sql_case(column: str, pairs: dict[str, str], otherwise: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {otherwise} END"


def spark_case(column: str, pairs: dict[str, str]):
    chosen = F.lit(None).cast("string")
    for k, v in pairs.items():
        chosen = F.when(F.col(column) == k, v).otherwise(chosen)
    return chosen


@query(f"SELECT {sql_case('event_type', SEVERITY_OF)} AS severity, count(*) AS n FROM events GROUP BY 1")
def severity_counts(spark, sf):
    action = spark_case("event_type", ACTION_OF)
    return table(spark, sf, "events").groupBy(messages.severity(action).alias("severity")).agg(F.count("*").alias("n"))


SAMPLE_ERRORS = [f"ERROR: {p[0]} on row" for p in messages.ERROR_PATTERNS] + ["something odd on row"]
REASON_SQL = f"upper(list_extract({SAMPLE_ERRORS}, CAST(event_id % {len(SAMPLE_ERRORS)} + 1 AS INTEGER))) || ' ' || CAST(event_id AS VARCHAR)"
CODE_SQL = "CASE " + " ".join(f"WHEN contains(lower(reason), '{p[0]}') THEN '{p[1]}'" for p in messages.ERROR_PATTERNS) + " ELSE 'ERR000' END"


def reasons(spark, sf):
    text = F.get(F.array(*[F.lit(e) for e in SAMPLE_ERRORS]), (F.col("event_id") % len(SAMPLE_ERRORS)).cast("int"))
    return table(spark, sf, "events").select("event_id", F.concat(F.upper(text), F.lit(" "), F.col("event_id").cast("string")).alias("reason"))


@query(f"SELECT code, count(*) AS n FROM (SELECT {CODE_SQL} AS code FROM (SELECT {REASON_SQL} AS reason FROM events)) GROUP BY code")
def error_codes(spark, sf):
    return tally_by_code(reasons(spark, sf))


_TEXT_SQL = "CASE " + " ".join(f"WHEN contains(lower(reason), '{p[0]}') THEN '{p[2]} (Code: {p[1]}). {p[3]}'" for p in messages.ERROR_PATTERNS)
_TEXT_SQL += " ELSE 'An unexpected error occurred (Code: ERR000). Please try again or contact support' END"


@query(f"SELECT event_id, {_TEXT_SQL} AS shown, ({CODE_SQL}) <> 'ERR000' AS known FROM (SELECT event_id, {REASON_SQL} AS reason FROM events)")
def error_texts(spark, sf):
    r = F.col("reason")
    return reasons(spark, sf).select("event_id", messages.error_text(r).alias("shown"), messages.is_known_error(r).alias("known"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, lower(p_type)) AS INTEGER) AS distance FROM part")
def edit_distance(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).alias("distance"))


@query("SELECT p_partkey, replace(p_name, ' ', '') || lower(p_type) AS header FROM part")
def header_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", messages.normalized_header(F.concat_ws("_ \t_", "p_name", "p_type")).alias("header"))


@query("SELECT c_custkey, 2 AS mapped, CAST(c_custkey % 9 AS INTEGER) AS name_at, c_name || ',' || c_mktsegment AS headers FROM customer")
def template_decode(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.format_string('{"name": %d, "segment": 1}', F.col("c_custkey") % 9).alias("column_mapping"),
        F.to_json(F.array("c_name", "c_mktsegment")).alias("csv_headers"),
    )
    decoded = mapping.decode_templates(rows)
    return decoded.select(
        "c_custkey",
        F.size("column_mapping").alias("mapped"),
        F.try_element_at("column_mapping", F.lit("name")).alias("name_at"),
        F.array_join("csv_headers", ",").alias("headers"),
    )
