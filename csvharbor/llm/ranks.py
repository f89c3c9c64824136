"""Places of rows in a global order, and draws of bounded size, without a group or the table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from csvharbor.operators.joins import small_side
from csvharbor.session import cut


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with ``place``, from 0 in the given order within each group, and ``total``, the rows of the group.

    Rows are dealt by range and sorted in their tasks; a group of any size spreads over many. Per task and group one count
    goes on to tell where its rows begin. Group columns must not be null. Rows equal in group and order are dealt together,
    so the order should end in a column that tells rows apart.
    """
    by, order = list(by), list(order)
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    written = cut(ranged.select("*", F.monotonically_increasing_id().alias("_at"), F.spark_partition_id().alias("_task")))
    runs = written.groupBy(*by, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("_n").over(group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select(*by, "_task", (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("total")))
    placed = written.join(small_side(runs), [*by, "_task"])
    return placed.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"), "total")


def drawn(rows: DataFrame, draw: str, size: int) -> DataFrame:
    """The ``size`` rows with the least ``draw``, a 64-bit hash of what tells rows apart; fewer if there are no more.

    Rows are counted first and those above a bound that leaves about twice as many, and 100, are dropped where they lie, so
    what is sorted at last does not grow with the table or its partitions.
    """
    n = rows.count()
    if n > 4 * size + 200:
        bound = int((2 * size + 100) / n * 2**64) - 2**63
        rows = rows.where(F.col(draw) < bound)
    return rows.orderBy(draw).limit(size)
