"""The cell functions and the retention rules as SQL functions with SQL bodies, for sessions that speak SQL only.

``register(spark)`` makes them temporary functions of the session. Spark puts their bodies into the query that calls them, so
they cost what the column functions cost and no Python runs. Fixed values are those of ``cells`` and ``messages``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from csvharbor.functions import cells, messages


def quoted(text: str) -> str:
    """A SQL text literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(words) -> str:
    return ", ".join(quoted(w) for w in words)


def _severity() -> str:
    cases = " ".join(f"WHEN action IN ({listed(actions)}) THEN {quoted(level)}" for level, actions in messages.SEVERITIES.items())
    return f"CASE {cases} ELSE 'medium' END"


def _error_code() -> str:
    cases = " ".join(f"WHEN contains(lower(reason), {quoted(pattern)}) THEN {quoted(code)}" for pattern, code, *_ in messages.ERROR_PATTERNS)
    return f"CASE WHEN reason IS NULL THEN NULL {cases} ELSE {quoted(messages.UNKNOWN_ERROR[0])} END"


def _rewritten(pattern: str, iso: str) -> str:
    """A date that the pattern, whole, rewrites to ISO; NULL for other text."""
    return f"CASE WHEN rlike(t, {quoted(pattern)}) THEN try_cast(regexp_replace(t, {quoted(pattern)}, {quoted(iso)}) AS DATE) END"


# Name with parameters, type, body; each may use those before it.
FUNCTIONS = (
    ("csv_trim(cell STRING)", "STRING", f"btrim(cell, {quoted(cells.WHITE_SPACE)})"),
    ("csv_unwrap(cell STRING)", "STRING", rf"CASE WHEN startswith(cell, '=') THEN regexp_replace(cell, {quoted(r'(?s)^=(?:"(.*)"\z)?')}, '$1') ELSE cell END"),
    ("csv_unprefix(cell STRING)", "STRING", "CASE WHEN startswith(cell, 'netsuite:') THEN substring(cell, 10) ELSE cell END"),
    ("csv_clean_cell(cell STRING)", "STRING", f"csv_unprefix(btrim(csv_unwrap(csv_trim(cell)), {quoted(chr(34) + chr(39))}))"),
    ("csv_text(cell STRING)", "STRING", "nullif(csv_trim(cell), '')"),
    ("csv_unmarked(t STRING)", "STRING", f"translate(regexp_replace(t, {quoted(r'(?s)^\((.*)\)\z')}, {quoted(chr(1) + '$1')}), {quoted('$€£,')}, '')"),
    ("csv_number_text(t STRING)", "STRING",
     f"regexp_extract(csv_trim(regexp_replace(csv_unmarked(t), {quoted(r'(?U)^' + chr(1) + r'\s*')}, '-')), {quoted(r'^[+-]?(?:\d+(?:\.\d*)?|\.\d+)\z')}, 0)"),
    ("csv_numeric(cell STRING)", "DECIMAL(28,10)", "try_cast(csv_number_text(csv_trim(cell)) AS DECIMAL(28,10))"),
    ("csv_bool(cell STRING)", "BOOLEAN",
     f"CASE WHEN lower(csv_trim(cell)) IN ({listed(cells.TRUE_WORDS)}) THEN true WHEN lower(csv_trim(cell)) IN ({listed(cells.FALSE_WORDS)}) THEN false END"),
    ("csv_long_date(t STRING)", "DATE",
     f"coalesce({_rewritten(r'^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})\z', '$4-$1-$3')}, {_rewritten(r'^(\d{4})([/.-]?)(\d{2})\2(\d{2})\z', '$1-$3-$4')})"),
    ("csv_named_date(t STRING)", "DATE", "coalesce(try_to_date(regexp_replace(t, ' +', ' '), 'MMM d, yyyy'), try_to_date(regexp_replace(t, ' +', ' '), 'd MMM yyyy'))"),
    ("csv_short_date(t STRING)", "DATE", _rewritten(r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{2})\z", "20$4-$1-$3")),
    ("csv_pivoted(day DATE, as_of_year INT)", "DATE",
     f"CASE WHEN year(day) > least(as_of_year + {cells.TWO_DIGIT_YEAR_WINDOW}, 2068) THEN add_months(day, -1200) ELSE day END"),
    ("csv_date_of(t STRING, as_of_year INT)", "DATE",
     "coalesce(CASE WHEN rlike(t, '[A-Za-z]{3}') THEN csv_named_date(t) ELSE csv_long_date(t) END, csv_pivoted(csv_short_date(t), as_of_year))"),
    ("csv_date(cell STRING, as_of_year INT)", "DATE", "csv_date_of(csv_trim(cell), as_of_year)"),
    ("csv_us_state(cell STRING)", "STRING",
     f"CASE WHEN map_contains_key(map({', '.join(f'{quoted(n)}, {quoted(c)}' for n, c in cells.US_STATES.items())}), lower(csv_trim(cell)))"
     f" THEN try_element_at(map({', '.join(f'{quoted(n)}, {quoted(c)}' for n, c in cells.US_STATES.items())}), lower(csv_trim(cell)))"
     f" WHEN upper(csv_trim(cell)) IN ({listed(cells.US_STATES.values())}) THEN upper(csv_trim(cell)) ELSE csv_trim(cell) END"),
    ("csv_error_code(reason STRING)", "STRING", _error_code()),
    ("csv_severity(action STRING)", "STRING", _severity()),
)

# Table functions over the views audit_log, audit_log_archive and sessions: what a step of the retention job takes.
RETENTION = {
    "audit_log": ("csv_archive_due(as_of TIMESTAMP, days INT)", "created_at < as_of - make_interval(0, 0, 0, days)"),
    "audit_log_archive": ("csv_purge_due(as_of TIMESTAMP, years INT)", "created_at < as_of - make_interval(years)"),
    "sessions": ("csv_expired(as_of TIMESTAMP)", "expires_at < as_of"),
}


def register(spark: SparkSession) -> list[str]:
    """Defines the functions in this session; table functions only where the view they read is there. Gives their names."""
    made = []
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
        made.append(head.split("(")[0])
    for view, (head, rule) in RETENTION.items():
        if spark.catalog.tableExists(view):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.table(view).schema.fields)
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({columns}) RETURN SELECT * FROM {view} WHERE {rule}")
            made.append(head.split("(")[0])
    return made
