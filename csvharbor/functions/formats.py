"""Typed values back to text: export, preview, keys, JSON and CSV fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from csvharbor.specs import FieldSpec, FieldType

KEY_SEPARATOR = "|"


def two_places(c: Column) -> Column:
    return c.cast("decimal(28,2)").cast("string")


def export_number(c: Column) -> Column:
    number = c.cast("decimal(28,10)")
    text = F.when(number == F.floor(number), number.cast("decimal(28,0)").cast("string")).otherwise(two_places(c))
    return F.when(c.isNull(), "").otherwise(text)


def preview_number(c: Column) -> Column:
    return F.when(c.isNull(), "").otherwise(F.regexp_replace(two_places(c), r"\.?0+$", ""))


def key_number(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c.cast("decimal(28,10)").cast("string"), r"\.?0+$", ""), F.lit(""))


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").when(~c, "No").otherwise("")


def iso_day(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def export_value(c: Column, kind: FieldType) -> Column:
    if kind is FieldType.NUMERIC:
        return export_number(c)
    if kind is FieldType.DATE:
        return iso_day(c)
    if kind is FieldType.BOOL:
        return yes_no(c)
    return F.coalesce(c, F.lit(""))


def preview_value(c: Column, kind: FieldType) -> Column:
    return preview_number(c) if kind is FieldType.NUMERIC else export_value(c, kind)


def key_value(c: Column, kind: FieldType) -> Column:
    return key_number(c) if kind is FieldType.NUMERIC else F.coalesce(c.cast("string"), F.lit(""))


def display_key(parts: Sequence[Column]) -> Column:
    """Key text of a stored row; NULL parts show as empty text."""
    return F.concat_ws(KEY_SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def record_key(parts: Sequence[Column]) -> Column:
    """Key text of an incoming record; NULL when any part is missing or blank."""
    present = F.lit(True)
    for part in parts:
        present = present & F.coalesce(part != "", F.lit(False))
    return F.when(present, F.concat_ws(KEY_SEPARATOR, *parts))


def split_key(key: Column, parts: int) -> Column:
    """Key text to its parts; NULL when the number of parts is wrong."""
    pieces = F.split(key, r"\|")
    return F.when(F.size(pieces) == parts, pieces)


def replace_key_part(key: Column, parts: int, position: int, value: Column) -> Column:
    """Key text with one part replaced; a key of another shape becomes the value itself."""
    pieces = F.split(key, r"\|")
    swapped = [value if i == position else F.get(pieces, F.lit(i)) for i in range(parts)]
    return F.when(F.size(pieces) == parts, F.concat_ws(KEY_SEPARATOR, *swapped)).otherwise(value)


def value_map(cells: dict[str, Column]) -> Column:
    """Cleaned cells by display name, absent ones left out."""
    entries = [F.when(c.isNotNull(), F.struct(F.lit(n).alias("key"), c.alias("value"))) for n, c in cells.items()]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def row_json(fields: Sequence[FieldSpec]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{f.column}`").alias(f.name) for f in fields]))


def csv_field(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\r\n]'), quoted).otherwise(c)


def escaped_text(c: Column) -> Column:
    """Double-quoted text with backslash escapes, as error reasons show values."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), c, F.lit('"'))
