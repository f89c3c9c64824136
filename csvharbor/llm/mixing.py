"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``most`` that give every source its target number of words, the balanced ones stay
closest to 1 in relative entropy. They are tilted exponentially, ``min(most, exp(tilt * size / mean size))``, with one
tilt per source: the root of the dual's gradient, found by Newton steps for all sources at once. A document's rate hangs
on its source and size alone, so the steps run over counts per source and size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.session import cut

SHARES = (3, 1, 2)
TOTAL = 1.5
MOST = 2
SLICE_ROWS = 1000
TOLERANCE = 1e-9
MAX_STEPS = 80
SOURCE = ["void", "name"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, shares: tuple[int, ...] = SHARES, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """Adds ``target`` to ``void, name, words``: sources by code point, null last, weigh ``shares`` in turn; a target stops at
    ``most`` times the source's words and the rest is shared on by weight. Only sums come to the driver: what is shared per
    unit of weight rises until no further source is full.
    """
    spark = sources.sparkSession
    kinds = "void boolean, name string, words long, rows long, place long"
    ordered = sources.select(*SOURCE, "words", "rows").orderBy(*SOURCE).rdd.zipWithIndex().map(lambda pair: (*pair[0], pair[1]))
    weight = F.element_at(F.array(*map(F.lit, shares)), (F.col("place") % len(shares) + 1).cast("int"))
    ranked = cut(spark.createDataFrame(ordered, kinds).withColumn("weight", weight).withColumn("limit", F.col("words") * most))
    unit, full = 0.0, -1
    while True:
        is_full = F.col("limit") <= F.col("weight") * unit
        row = ranked.agg(F.sum(is_full.cast("long")), F.sum(F.when(is_full, F.col("limit"))), F.sum(F.when(~is_full, F.col("weight"))), F.sum("words")).first()
        if row[0] in (full, None) or not row[2]:
            break
        full, unit = row[0], (total * row[3] - (row[1] or 0)) / row[2]
    return ranked.withColumn("target", F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(unit))).drop("place", "weight", "limit")


def _rate(most: int = MOST) -> Column:
    return F.when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))))


def tilts(cells: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """Adds ``tilt`` (null: everything at ``most``) and ``mean`` to the sources of ``aims``.

    Each step sums the rates' words and their slope over ``cells`` (``void, name, size, rows``). A step that would leave
    the interval known to hold the root halves it instead.
    """
    aims = aims.withColumn("mean", F.col("words") / F.col("rows"))
    solid = F.col("words") > 0
    fixed = aims.where(~solid | (F.col("target") >= F.col("words") * most)).withColumn("tilt", F.lit(None).cast("double"))
    state = cut(aims.where(solid & (F.col("target") < F.col("words") * most)).withColumn("tilt", F.lit(0.0)).withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double")))
    for _ in range(MAX_STEPS):
        rate, words = _rate(most), F.col("size") * F.col("rows")
        # What a source has of its own is alike in all of its rows and goes along with the sums, so a step needs no second join.
        own = ["words", "documents", "target", "mean", "tilt", "low", "high"]
        now = cells.join(state.withColumnRenamed("rows", "documents"), SOURCE).groupBy(*SOURCE).agg(
            F.sum(words * rate).alias("got"), F.sum(F.when(rate < most, words * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"), *[F.first(c).alias(c) for c in own]
        ).withColumnRenamed("documents", "rows")
        off = F.abs(F.col("got") - F.col("target")) / F.col("target")
        done = off <= TOLERANCE
        low, high = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low")), F.when(F.col("got") >= F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        now = now.withColumn("done", done).withColumn("low", low).withColumn("high", high)
        newton = F.col("tilt") + (F.col("target") - F.col("got")) / F.col("slope")
        inside = newton.isNotNull() & (F.col("slope") > 0) & (newton > F.coalesce("low", F.col("tilt") - 4)) & (newton < F.coalesce("high", F.col("tilt") + 4))
        halved = F.when(F.col("low").isNull(), F.col("high") - 4).when(F.col("high").isNull(), F.col("low") + 4).otherwise((F.col("low") + F.col("high")) / 2)
        state = cut(now.withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(inside, newton).otherwise(halved)).drop("got", "slope"))
        if state.where(~F.col("done")).isEmpty():
            break
        state = state.drop("done")
    # Sums may differ in their last digits from run to run; tilts of nine digits do not.
    state = state.withColumn("tilt", F.round("tilt", 9))
    columns = [*SOURCE, "words", "rows", "target", "mean", "tilt"]
    return fixed.select(columns).union(state.select(columns))


def _rounded(most: int):
    def rounded(slice_: pd.DataFrame) -> pd.DataFrame:
        """Large documents first; what rounding leaves over goes to the next. A row stands for ``alike`` documents."""
        slice_ = slice_.sort_values(["size", "id", "part"], ascending=[False, True, True], kind="stable")
        left, copies = 0.0, []
        for size, rate, alike in zip(slice_["size"].tolist(), slice_["rate"].tolist(), slice_["alike"].tolist(), strict=True):
            copies.append([1] * alike)
            for k in range(alike if size else 0):
                want = rate * size + left
                copies[-1][k] = min(most, max(0, int(want / size + 0.5)))
                left = want - copies[-1][k] * size
        return slice_.assign(copies=copies).drop(columns=["rate", "part", "alike"])

    return rounded


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", shares: tuple[int, ...] = SHARES, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """``id, source, size, source_size, target, copies`` per row, where size counts the words of the text (null: 0).

    ``copies`` (0 to ``most``) makes the words taken from each source come to its target but for a remainder about as large
    as the smallest documents. A source without words has target 0; documents without words are kept once, which takes
    nothing. A null source is a source of its own; other columns are not looked at. An empty table gives an empty result.

    Rounding goes over slices of about ``SLICE_ROWS`` rows that a hash makes within each source, so that a large source is
    never gathered in one task. Rows alike in id, source and size are counted first and dealt in parts of ``SLICE_ROWS``.
    """
    sized = cut(
        docs.select(F.col(id_column).alias("id"), F.col(source).isNull().alias("void"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"), word_count(F.col(text)).alias("size"))
    )
    cells = cut(sized.groupBy(*SOURCE, "size").agg(F.count("*").alias("rows")))
    sources = cells.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.sum("rows").alias("rows"))
    aims = cut(tilts(cells, targets(sources, shares, total, most), most))
    last = F.floor((F.col("n") - 1) / SLICE_ROWS)
    parts = sized.groupBy("id", *SOURCE, "size").agg(F.count("*").alias("n")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    alike = F.least(F.lit(SLICE_ROWS).cast("long"), F.col("n") - F.col("part") * SLICE_ROWS)
    placed = parts.withColumn("alike", alike).join(aims, SOURCE).withColumn("rate", _rate(most))
    drawn = F.when(F.col("part") == 0, F.xxhash64("id", "size")).otherwise(F.xxhash64("id", "size", "part"))
    slices = F.pmod(drawn, F.ceil(F.col("rows") / SLICE_ROWS))
    placed = placed.select("id", *SOURCE, "size", F.col("words").alias("source_size"), "target", "rate", slices.alias("slice"), "part", "alike")
    kind = dict(sized.dtypes)["id"]
    done = placed.groupBy(*SOURCE, "slice").applyInPandas(_rounded(most), f"id {kind}, void boolean, name string, size long, source_size long, target double, slice long, copies array<int>")
    done = done.withColumn("copies", F.explode("copies"))
    return done.select("id", F.when(~F.col("void"), F.col("name")).alias("source"), "size", "source_size", "target", F.col("copies").cast("long").alias("copies")).withColumnRenamed("id", id_column)
