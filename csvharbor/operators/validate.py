"""Row checks as column expressions over cleaned cells (NULL = the file has no such cell, '' = blank)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.functions import messages
from csvharbor.functions.cells import convert, normalized, number_too_long
from csvharbor.functions.formats import escaped_text
from csvharbor.operators.joins import existing_keys, lookup_join
from csvharbor.session import cut
from csvharbor.specs import FieldSpec, FieldType

Cells = Mapping[str, Column]

# Messages for texts that do not fit their type.
CELL_MESSAGES = {
    FieldType.NUMERIC: "invalid number format",
    FieldType.DATE: "invalid date format (use YYYY-MM-DD or similar)",
    FieldType.BOOL: "must be yes/no, true/false, or 1/0",
}
TOO_LONG = "number out of range"
EDIT_DATE_MESSAGE = "invalid date format (use YYYY-MM-DD)"


def _in_enum(value: Column, spec: FieldSpec) -> Column:
    return F.lower(value).isin(*[v.lower() for v in spec.enum_values])


def with_values(df: DataFrame, cells: Cells, fields: Sequence[FieldSpec], as_of_year: int) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with every cell's converted value as a column of its own, worked out once, and these columns by field."""
    made = {f"_value_{k}": convert(normalized(cells[f.name], f), f, as_of_year) for k, f in enumerate(fields)}
    return df.withColumns(made), {f.name: F.col(f"_value_{k}") for k, f in enumerate(fields)}


def cell_error(value: Column, spec: FieldSpec, as_of_year: int, editing: bool = False, typed: Column | None = None) -> Column:
    """Message for text that does not fit the field's type; blank text always fits."""
    none = F.lit(None).cast("string")
    if spec.type is FieldType.ENUM:
        if not spec.enum_values:
            return none
        return F.when((value != "") & ~_in_enum(value, spec), "value must be one of: " + ", ".join(spec.enum_values))
    if spec.type not in CELL_MESSAGES:
        return none
    message = EDIT_DATE_MESSAGE if editing and spec.type is FieldType.DATE else CELL_MESSAGES[spec.type]
    error = F.when((value != "") & (convert(value, spec, as_of_year) if typed is None else typed).isNull(), message)
    return F.when(number_too_long(value), TOO_LONG).otherwise(error) if spec.type is FieldType.NUMERIC else error


def _type_mismatch(value: Column, spec: FieldSpec, as_of_year: int, typed: Column | None) -> Column:
    if spec.type is FieldType.ENUM:
        return ~_in_enum(value, spec) if spec.enum_values else F.lit(True)
    if spec.type is FieldType.TEXT:
        return F.lit(False)
    return (convert(value, spec, as_of_year) if typed is None else typed).isNull()


def row_errors(cells: Cells, fields: Sequence[FieldSpec], as_of_year: int, typed: Cells | None = None) -> Column:
    """Every error of the row as (field, value, message), NULL for a field without one; optional fields are checked too.

    The array is left as it is made, because that much runs as generated code; ``error_table`` drops the NULLs.
    """
    kind = "struct<field:string,value:string,message:string>"
    errors = []
    for spec in fields:
        cell = cells[spec.name]
        value = normalized(cell, spec)

        def entry(shown: Column, message: Column, spec: FieldSpec = spec) -> Column:
            return F.struct(F.lit(spec.name).alias("field"), shown.alias("value"), message.alias("message")).cast(kind)

        found = cell_error(value, spec, as_of_year, typed=typed[spec.name] if typed else None)
        error = F.when(found.isNotNull(), entry(value, found))
        if spec.required and not spec.allow_empty:
            error = F.when(cell == "", entry(F.lit(""), F.lit("required field is empty"))).otherwise(error)
        if spec.required:
            error = F.when(cell.isNull(), entry(F.lit(""), F.lit("missing required column"))).otherwise(error)
        errors.append(error)
    return F.array(*errors)


def field_reason(cell: Column, spec: FieldSpec, as_of_year: int, strict: bool = False, typed: Column | None = None) -> Column:
    """Why the cell rejects its row; types count for required fields, with ``strict`` for all.

    ``typed`` is the converted value where it is at hand, so that the text is converted once.
    """
    quoted = escaped_text(F.lit(spec.name))
    value = normalized(cell, spec)
    reason = F.lit(None).cast("string")
    if spec.required or strict:
        text = F.concat(F.lit(f"invalid {spec.type.value} for "), quoted, F.lit(": "), escaped_text(value))
        reason = F.when((value != "") & _type_mismatch(value, spec, as_of_year, typed), text)
    if spec.type is FieldType.NUMERIC:  # whatever the settings, a number is stored whole or its row is refused
        lost = F.concat(F.lit(TOO_LONG + " for "), quoted, F.lit(": "), escaped_text(value))
        reason = F.when(number_too_long(value), lost).otherwise(reason)
    if spec.required and not spec.allow_empty:
        reason = F.when(cell == "", F.concat(F.lit("empty required field "), quoted)).otherwise(reason)
    if spec.required:
        reason = F.when(cell.isNull(), F.concat(F.lit("missing required column "), quoted)).otherwise(reason)
    return reason


def _reasons(cells: Cells, fields: Sequence[FieldSpec], as_of_year: int, strict: bool, typed: Cells | None) -> list[Column]:
    return [field_reason(cells[f.name], f, as_of_year, strict, typed[f.name] if typed else None) for f in fields]


def first_reason(cells: Cells, fields: Sequence[FieldSpec], as_of_year: int, strict: bool = False, typed: Cells | None = None) -> Column:
    return F.coalesce(F.lit(None).cast("string"), *_reasons(cells, fields, as_of_year, strict, typed))


def all_reasons(cells: Cells, fields: Sequence[FieldSpec], as_of_year: int, strict: bool = False, typed: Cells | None = None) -> Column:
    return F.array_compact(F.array(*_reasons(cells, fields, as_of_year, strict, typed)))


def reason_text(cells: Cells, fields: Sequence[FieldSpec], as_of_year: int, strict: bool = False, typed: Cells | None = None) -> Column:
    """All reasons in one text, without the array in between."""
    return F.concat_ws("; ", *_reasons(cells, fields, as_of_year, strict, typed))


def width_reason(tokens: Column, expected: int) -> Column:
    got = F.size(tokens)
    return F.when(got < expected, F.format_string(f"expected {expected} columns, got %d", got))


def error_table(df: DataFrame, errors: str, *keys: str) -> DataFrame:
    """One row per error. The outer form keeps Spark from working the errors out a second time for a filter."""
    return df.select(*keys, F.inline_outer(errors)).filter(F.col("field").isNotNull())


def tally_by_code(rejected: DataFrame, reason: str = "reason") -> DataFrame:
    """Rejected rows per support code."""
    code = messages.error_code(F.col(reason))
    return rejected.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


def split_by_domain(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Rows whose values lie in the allowed lists, and the others with a reason."""
    reason = F.coalesce(
        *[
            F.when(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)), F.concat(F.lit(f"{c} not allowed: "), F.coalesce(F.col(c), F.lit("NULL"))))
            for c, allowed in domains.items()
        ]
    )
    checked = df.withColumn("reason", reason)
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


AUDIT_DOMAINS = {"action": messages.ACTIONS, "severity": messages.SEVERITY_LEVELS}
UPLOAD_DOMAINS = {"status": messages.UPLOAD_STATUSES}


def not_yet_present(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key is not taken: the uniqueness rule of an append."""
    return lookup_join(new, cut(existing_keys(new, existing, keys)), keys, "left_anti").select(new.columns)
