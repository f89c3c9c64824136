"""Where each expected column sits in each file."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.functions.cells import bound, clean_cells
from csvharbor.specs import FieldSpec, TableSpec


def header_names(header: Column) -> Column:
    return F.transform(clean_cells(header), F.lower)


def header_index(header: Column) -> Column:
    """Lower-case name to zero-based position; of equal names the last one counts."""

    def index(names: Column) -> Column:
        def entry(name: Column) -> Column:
            last = F.size(names) - F.array_position(F.reverse(names), name)
            return F.struct(name.alias("key"), last.cast("int").alias("value"))

        return F.map_from_entries(F.transform(F.array_distinct(names), entry))

    return bound(header_names(header), index)


def mapped_index(mapping: Column, header: Column) -> Column:
    """Explicit mapping, lower-cased, without positions outside the header."""
    inside = F.map_filter(mapping, lambda _, at: (at >= 0) & (at < F.size(header)))
    return F.transform_keys(inside, lambda name, _: F.lower(name))


def mapping_literal(mapping: Mapping[str, int]) -> Column:
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.create_map(*pairs).cast("map<string,int>") if pairs else F.lit(None).cast("map<string,int>")


def positions(index: Column, spec: TableSpec) -> Column:
    """Zero-based position per field of the table, NULL where the file lacks it."""
    return bound(index, lambda known: F.array(*[F.try_element_at(known, F.lit(f.name.lower())) for f in spec.fields]))


def missing_columns(header: Column, fields: Sequence[FieldSpec]) -> Column:
    """Names of required columns that the header lacks, in table order."""
    required = [F.struct(F.lit(f.name).alias("name"), F.lit(f.name.lower()).alias("low")) for f in fields if f.required]
    if not required:
        return F.array().cast("array<string>")

    def lacking(names: Column) -> Column:
        return F.filter(F.array(*required), lambda r: ~F.array_contains(names, r["low"]))

    return F.transform(bound(header_names(header), lacking), lambda r: r["name"])


def missing_columns_error(header: Column, fields: Sequence[FieldSpec]) -> Column:
    missing = missing_columns(header, fields)
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing required columns: "), F.array_join(missing, ", ")))


def header_positions(headers: DataFrame, spec: TableSpec, mapping: Mapping[str, int] | None = None) -> DataFrame:
    index = mapped_index(mapping_literal(mapping), F.col("header")) if mapping else header_index(F.col("header"))
    return headers.select("file", "header_no", "header", positions(index, spec).alias("positions"))
