"""Near-duplicate embeddings: sign hashing by random hyperplanes, exact cosines in blocks, connected components.

Vectors of one label meet where all bits of a table agree. Buckets of any size are cut into blocks and every pair of blocks
is one piece of work, which returns sums per vector, never pairs: a link counts in the first table where its vectors meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csvharbor.llm.components import components, spread
from csvharbor.operators.joins import lookup_join
from csvharbor.session import cut

BITS = 20
MISS = 1e-6
BLOCK_ROWS = 512
_planes: dict[tuple[int, int, int], np.ndarray] = {}


def table_count(cosine: float, bits: int = BITS, miss: float = MISS) -> int:
    """Tables after which two vectors at the threshold have met nowhere with probability ``miss`` at most."""
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-together))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, whatever their size."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def codes(units: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The sides of the hyperplanes as one number per table."""
    key = (units.shape[1], tables, bits)
    if key not in _planes:
        _planes[key] = np.random.default_rng(97).standard_normal((units.shape[1], tables * bits))
    sides = (units @ _planes[key] >= 0).reshape(len(units), tables, bits)
    return sides @ (1 << np.arange(bits, dtype=np.int64))


def _hashed(tables: int, bits: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            out: list = [None] * len(lists)
            by_size: dict[int, list[int]] = {}
            for k, n in enumerate(lists.value_lengths().to_pylist()):
                if n:
                    by_size.setdefault(n, []).append(k)
            for places in by_size.values():
                vectors = lists.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(places), -1)
                good = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
                for k, row in zip(np.array(places)[good].tolist(), codes(unit(vectors[good]), tables, bits).astype(np.int32) if good.any() else [], strict=True):
                    out[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], ["id", "vector", "label", "codes"])

    return hashed


def _counted(cosine: float):
    def counted(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        one, two, table = key[1].as_py(), key[2].as_py(), key[3].as_py()
        ids, sizes, part = (group.column(c).to_numpy() for c in ("id", "copies", "part"))
        read = lambda c, kind: np.array(group.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), kind).reshape(len(ids), -1)
        units, signs = unit(read("vector", np.float64)), read("codes", np.int32)
        a, b = np.flatnonzero(part == one), np.flatnonzero(part == two)
        linked = units[a] @ units[b].T >= cosine
        if one == two:
            np.fill_diagonal(linked, False)
        new = linked.copy()
        for k in range(table):
            new &= signs[a, k][:, None] != signs[b, k][None]
        n = np.zeros(len(ids), np.int64)
        n[a] += new @ sizes[b]
        if one != two:
            n[b] += new.T @ sizes[a]
        least = ids.copy()
        least[a], least[b] = spread(linked, ids[a], ids[b])
        if one == two:
            least = np.minimum(least, ids)
        keep = (n > 0) | (least < ids)
        return pa.table({"id": ids[keep], "n": n[keep], "least": least[keep]})

    return counted


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, bits: int = BITS
) -> DataFrame:
    """``id, n_links, component`` per row, for links of at least ``cosine`` between rows of one label.

    Rows whose label or vector is null, zero, or holds a null or non-finite number link with nothing, nor do vectors of
    different lengths. Equal vectors are one class with a count; each row counts all other rows that it links with. Rows that
    repeat an id are in one component, whatever their vectors, and each counts the links of its own vector. A row without
    an id links with nothing. Other columns are not looked at.
    """
    tables = table_count(cosine, bits)
    source = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector)).cast("array<double>").alias("vector"),
        F.col(label).alias("label"),
    )
    kind = dict(source.dtypes)["label"]
    hashed = cut(
        source.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
        .mapInArrow(_hashed(tables, bits), f"id long, vector array<double>, label {kind}, codes array<int>")
        .where("codes IS NOT NULL")
        .withColumn("size", F.size("vector")).withColumn("lo", F.xxhash64("vector")).withColumn("hi", F.xxhash64(F.lit(7), "vector"))
    )
    same = ["label", "size", "lo", "hi"]
    classes = cut(hashed.groupBy(*same).agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("class", F.monotonically_increasing_id()))
    member = cut(hashed.select("id", *same).join(classes, same).select("id", "class", "copies"))
    reps = hashed.join(classes.select(F.col("least").alias("id"), *same, "class", "copies"), ["id", *same]).dropDuplicates(["class"])
    reps = cut(reps.select(F.col("class").alias("id"), "copies", "vector", "label", "size", "codes"))
    entries = reps.select("id", "label", "size", F.posexplode("codes").alias("t", "code")).select("id", "t", F.xxhash64("label", "size", "t", "code").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK_ROWS).alias("parts"))
    met = entries.join(buckets, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    pieces = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "t", "part", "id"
    )
    work = pieces.join(reps.select("id", "copies", "vector", "codes"), "id")
    counted = cut(work.groupBy("key", "one", "two", "t").applyInArrow(_counted(cosine), "id long, n long, least long"))
    totals = counted.groupBy(F.col("id").alias("class")).agg(F.sum("n").alias("n"))
    # Classes are linked by cosine, or because rows of one id stand in both.
    held = member.groupBy("id").agg(F.min("class").alias("v"), F.max("class").alias("last")).where("v != last").select("id", "v")
    shared = member.join(held, "id").select(F.col("class").alias("u"), "v")
    groups = components(counted.where("least < id").select(F.col("id").alias("u"), F.col("least").alias("v")).union(shared))
    grouped = cut(member.join(groups.withColumnRenamed("id", "class"), "class", "left").withColumn("g", F.coalesce("component", "class")).drop("component"))
    smallest = grouped.groupBy("g").agg(F.min("id").alias("component"))
    found = lookup_join(grouped.join(totals, "class", "left"), cut(smallest), ["g"])
    found = found.select("id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component")
    # Rows that cannot link: as many of an id as have no vector among the hashed; the id's component is theirs too.
    every, able = (f.groupBy("id").agg(F.count("*").alias(n)) for f, n in ((source.where("id IS NOT NULL"), "every"), (hashed, "able")))
    void = every.join(able, "id", "left").select("id", (F.col("every") - F.coalesce("able", F.lit(0))).alias("n")).where("n > 0")
    owned = found.groupBy("id").agg(F.min("component").alias("component"))
    void = void.join(owned, "id", "left").select("id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"), "component")
    found = found.union(void.select("id", F.lit(0).cast("long"), F.coalesce("component", "id")))
    nameless = source.select("id").where("id IS NULL")
    return found.union(nameless.select("id", F.lit(0).cast("long"), "id")).withColumnRenamed("id", id_column)


#: The same in plain SQL, all pairs of a label compared.
COMPONENTS_SQL = """
WITH RECURSIVE s AS (
  SELECT row_number() OVER () AS r, vec_id AS id, label,
    CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN embedding::DOUBLE[] END AS v FROM embeddings),
able AS (
  SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM s
  WHERE id IS NOT NULL AND label IS NOT NULL AND len(list_filter(v, lambda x: x != 0)) > 0),
e AS (
  SELECT a.r AS ra, a.id AS u, b.id AS v FROM able a JOIN able b ON a.label = b.label AND a.r != b.r
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) >= 0.98 * a.norm * b.norm ELSE false END),
n AS (SELECT ra AS r, count(*) AS n FROM e GROUP BY ra),
near AS (SELECT DISTINCT u, v FROM e WHERE u != v),
reach(id, c) AS (SELECT DISTINCT id, id FROM s WHERE id IS NOT NULL UNION SELECT near.v, c FROM reach JOIN near ON near.u = reach.id),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT s.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp.c AS component_id, coalesce(s.id = comp.c, true) AS kept
FROM s LEFT JOIN n ON n.r = s.r LEFT JOIN comp ON comp.id = s.id
"""
