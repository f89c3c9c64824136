"""Connected components of a graph too large for one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csvharbor.session import cut


def spread(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each row and column of the matrix of links reaches within it."""
    most = np.iinfo(np.int64).max
    while True:
        new_rows = np.minimum(rows, np.where(linked, columns[None], most).min(1, initial=most))
        new_columns = np.minimum(columns, np.where(linked, new_rows[:, None], most).min(0, initial=most))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex either has one link down, or links up only: then those of a component hang on its least one."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 AND down > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every vertex of the links ``(u, v)``: the smallest vertex that can be reached.

    Alternating large and small stars: each round points the larger neighbours of a vertex at its least neighbour, then
    the smaller ones, until every vertex hangs on the least of its component. Least neighbours are aggregates, and the
    joins back to the edges may be split, so that a vertex with very many links is not gathered in one place. Every round
    is written to the shared folder. Null and self links are left out; without links the result is empty.
    """
    edges = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        tips = _least(large)
        small = large.join(tips, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(tips.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct()
