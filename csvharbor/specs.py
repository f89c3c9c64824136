"""Field and table specifications, and the registry that lists them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FieldType(str, Enum):
    TEXT = "text"
    ENUM = "enum"
    DATE = "date"
    NUMERIC = "numeric"
    BOOL = "bool"


# Sums of decimal(28,10) stay within decimal(38,10).
SPARK_TYPES: dict[FieldType, T.DataType] = {
    FieldType.TEXT: T.StringType(),
    FieldType.ENUM: T.StringType(),
    FieldType.DATE: T.DateType(),
    FieldType.NUMERIC: T.DecimalType(28, 10),
    FieldType.BOOL: T.BooleanType(),
}


def column_name(display: str) -> str:
    return display.replace(" ", "_").lower()


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: FieldType = FieldType.TEXT
    required: bool = False
    allow_empty: bool = True
    db_column: str | None = None
    enum_values: tuple[str, ...] = ()
    normalizer: Callable[[Column], Column] | None = None
    not_null: bool = False

    @property
    def column(self) -> str:
        return self.db_column or column_name(self.name)


@dataclass(frozen=True)
class TableSpec:
    key: str
    group: str
    label: str
    directory: str
    unique_key: tuple[str, ...]
    fields: tuple[FieldSpec, ...]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def key_columns(self) -> list[str]:
        return [self.resolve(k) for k in self.unique_key]

    def field(self, name: str) -> FieldSpec | None:
        wanted = name.lower()
        return next((f for f in self.fields if f.name.lower() == wanted), None)

    def resolve(self, name: str) -> str:
        """Display name, in any case, to stored column name."""
        found = self.field(name)
        return found.column if found else column_name(name)

    def of_type(self, *kinds: FieldType) -> list[FieldSpec]:
        return [f for f in self.fields if f.type in kinds]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.column, SPARK_TYPES[f.type]) for f in self.fields])

    def display(self, df: DataFrame) -> DataFrame:
        """Stored columns under their display names."""
        return df.select(*[F.col(f"`{f.column}`").alias(f.name) for f in self.fields])


class Registry:
    def __init__(self) -> None:
        self._tables: dict[str, TableSpec] = {}

    def register(self, spec: TableSpec) -> TableSpec:
        if spec.key in self._tables:
            raise ValueError(f"table already registered: {spec.key}")
        self._tables[spec.key] = spec
        return spec

    def get(self, key: str) -> TableSpec:
        if key not in self._tables:
            raise KeyError(f"unknown table: {key}")
        return self._tables[key]

    def all(self) -> list[TableSpec]:
        return sorted(self._tables.values(), key=lambda s: (s.group, s.key))

    def by_group(self, group: str) -> list[TableSpec]:
        return [s for s in self.all() if s.group == group]

    def groups(self) -> list[str]:
        return sorted({s.group for s in self._tables.values()})

    def __len__(self) -> int:
        return len(self._tables)

    def catalog(self, spark: SparkSession) -> DataFrame:
        rows = [(s.key, s.group, s.label, s.directory, list(s.unique_key), s.names) for s in self.all()]
        schema = "key string, `group` string, label string, directory string, unique_key array<string>, columns array<string>"
        return spark.createDataFrame(rows, schema).orderBy("group", "key")
