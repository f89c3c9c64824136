"""Query registration, the given tables and their specs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from csvharbor.specs import FieldSpec, FieldType, TableSpec

AS_OF_YEAR = 2026
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or run.__name__] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec(key: str, unique: str, fields: str) -> TableSpec:
    """``name:type`` entries; text where no type is given."""
    parts = [entry.partition(":") for entry in fields.split()]
    return TableSpec(key, "Sales", key, key, tuple(unique.split()), tuple(FieldSpec(n, FieldType(t or "text")) for n, _, t in parts))


CUSTOMER = spec("customer", "c_custkey", "c_custkey:numeric c_name c_nationkey:numeric c_acctbal:numeric c_mktsegment")
ORDERS = spec(
    "orders", "o_orderkey",
    "o_orderkey:numeric o_custkey:numeric o_orderstatus o_totalprice:numeric o_orderdate:date o_orderpriority",
)
PART = spec("part", "p_partkey", "p_partkey:numeric p_name p_brand p_type p_size:numeric p_retailprice:numeric")
LINEITEM = spec(
    "lineitem", "l_orderkey l_linenumber",
    "l_orderkey:numeric l_partkey:numeric l_suppkey:numeric l_linenumber:numeric l_quantity:numeric l_extendedprice:numeric"
    " l_discount:numeric l_tax:numeric l_returnflag l_linestatus l_shipdate:date",
)


def double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def pick(number: Column, *choices: Column) -> Column:
    """One of the choices by remainder."""
    chosen = choices[-1]
    for i, choice in enumerate(choices[:-1]):
        chosen = F.when(number % len(choices) == i, choice).otherwise(chosen)
    return chosen


def day(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)
