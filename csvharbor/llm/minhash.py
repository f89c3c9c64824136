"""Near-duplicate documents by circulant MinHash.

Two permutations of the 32-bit numbers make every coordinate of a signature: the first scatters the shingles, the second,
shifted by one place per coordinate, ranks them, and the least rank is the coordinate. Bands of coordinates propose
pairs; the Jaccard similarity of the full shingle sets decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csvharbor.llm.components import components, spread
from csvharbor.llm.ranks import numbered
from csvharbor.llm.textarrays import blocks, mix, shingles, word_hashes, words
from csvharbor.operators.joins import lookup_join
from csvharbor.session import cut

COORDINATES = 450
MISS = 1e-6
FEW = 32
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 500_000
_COLUMNS = 4096


def banding(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> tuple[int, int]:
    """(rows, bands): the longest bands for which a pair at the threshold meets in fewer than two with probability ``miss`` at most."""
    fits = (1, 2)
    for rows in range(1, 33):
        together, bands = (percent / 100) ** rows, 2
        while rows * bands <= coordinates and (1 - together) ** bands + bands * together * (1 - together) ** (bands - 1) > miss:
            bands += 1
        if rows * bands <= coordinates:
            fits = (rows, bands)
    return fits


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Row per set (none empty), column per coordinate."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    base = _scatter((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32))
    out = np.empty((coordinates, len(sets)), np.uint32)
    rank, other = np.empty_like(base), np.empty_like(base)
    for k in range(coordinates):  # the second permutation, read k places further on
        np.add(base, np.uint32(k), out=rank)
        np.multiply(rank, np.uint32(0x9E3779B1), out=rank)
        np.right_shift(rank, np.uint32(15), out=other)
        np.bitwise_xor(rank, other, out=rank)
        np.multiply(rank, np.uint32(0x85EBCA77), out=rank)
        np.right_shift(rank, np.uint32(13), out=other)
        np.bitwise_xor(rank, other, out=rank)
        np.multiply(rank, np.uint32(0xC2B2AE3D), out=rank)
        np.minimum.reduceat(rank, starts, out=out[k])
    return out.T


def _sketch(width: int, rows: int, bands: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = words(block)
                sets = shingles(word_hashes(block, found), found, width)
                full = [i for i, x in enumerate(sets) if len(x)]
                keys: list = [None] * len(sets)
                if full:
                    ranks = signatures([sets[i] for i in full], rows * bands).astype(np.uint64).reshape(len(full), bands, rows)
                    folded = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(full), bands))
                    for k in range(rows):
                        folded = mix(folded * np.uint64(0x2545F4914F6CDD1D) + ranks[:, :, k])
                    for i, row in zip(full, folded.astype(np.int64), strict=True):
                        keys[i] = row
                digest = lambda salt: pa.array([int(np.sum(mix(x ^ np.uint64(salt)), dtype=np.uint64).astype(np.int64)) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(sets)), pa.array([len(x) for x in sets], pa.int64()), digest(1), digest(0x5851F42D4C957F2D), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "n", "lo", "hi", "keys"],
                )

    return sketch


def _confirm(width: int, percent: int):
    """Rows whose two texts are as similar as the threshold asks."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides: list[list[np.ndarray]] = [[], []]
            for side, sets in enumerate(sides):
                for block in blocks(batch.column(2 + side)):
                    found = words(block)
                    sets += shingles(word_hashes(block, found), found, width)
            linked = []
            for x, y in zip(*sides, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return confirm


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = words(block)
                lists = [x.astype(np.int64) for x in shingles(word_hashes(block, found), found, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(lists)), pa.array(lists, pa.list_(pa.int64()))], ["id", "shingles"])

    return sets


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of two lists. Only members that both lists have are looked at."""
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two)]
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (one, two)]
    shared = np.intersect1d(flat[0], flat[1])
    out = np.zeros((len(one), len(two)), np.int64)
    if not len(shared):
        return out
    places = [np.searchsorted(shared, x) for x in flat]
    hits = [shared[np.minimum(p, len(shared) - 1)] == x for p, x in zip(places, flat, strict=True)]
    for at in range(0, len(shared), _COLUMNS):
        sides = []
        for place, hit, owner, lists in zip(places, hits, owners, (one, two), strict=True):
            here = hit & (place >= at) & (place < at + _COLUMNS)
            side = np.zeros((len(lists), min(_COLUMNS, len(shared) - at)), np.float32)
            side[owner[here], place[here] - at] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _blocked(percent: int):
    """Within two parts of a bucket: each class with the least id that it reaches over links."""

    def blocked(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        one, two = key[1].as_py(), key[2].as_py()
        ids, part = group.column("id").to_numpy(), group.column("part").to_numpy()
        sets = [x.values.to_numpy() for x in group.column("shingles").combine_chunks()]
        a, b = np.flatnonzero(part == one), np.flatnonzero(part == two)
        both = overlaps([sets[k] for k in a], [sets[k] for k in b])
        sizes = np.array([len(x) for x in sets], np.int64)
        linked = (both > 0) & (100 * both >= percent * (sizes[a][:, None] + sizes[b][None] - both))
        least = ids.copy()
        rows, columns = spread(linked, ids[a], ids[b])
        least[a] = rows
        least[b] = np.minimum(least[b], columns)
        return pa.table({"u": least[least < ids], "v": ids[least < ids]})

    return blocked


def apart(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """Rows ``(given, id, ...)`` with ids under which one text stands only, and the ids that were made up, ``(id, given)``, if any.

    Of an id's texts one keeps it; each other one gets an id of its own above all given ones. All columns of the rows stay,
    in a struct ``doc``. Null ids stay null.
    """
    rows = docs.select(F.col(id_column).alias("given"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    held = rows.where("given IS NOT NULL").groupBy("given").agg(F.min("h").alias("first"), F.max("h").alias("last"))
    several = cut(held.where("first != last").select("given", "first"))
    if several.isEmpty():
        return rows.withColumn("id", F.col("given")), None
    highest = rows.agg(F.max("given")).first()[0]
    others = rows.select("given", "h").join(several, "given").where("h != first").select("given", "h").distinct()
    made = numbered(cut(others.withColumn("one", F.lit(0))), ["one"], ["given", "h"])
    made = cut(made.select("given", "h", (F.col("place") + (highest + 1)).alias("new")))
    joined = lookup_join(rows, made, ["given", "h"], "left")
    return joined.withColumn("id", F.coalesce("new", "given")).drop("new"), made.select(F.col("new").alias("id"), "given")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """``id, n_shingles, component`` per row: component is the least id reachable over links of at least ``percent`` Jaccard.
    Ids are integers.

    Words are lower-cased (A-Z) runs without white space; a text's set holds its distinct shingles of ``width`` words, or
    the whole of a shorter text. Texts that are null or without words link with nothing and are their own component. Rows
    that repeat an id are in one component; if their texts differ, each row's links are those of its own text. A row without
    an id links with nothing and has no component. Other columns are not looked at.

    Equal sets are one class, so copies cost no pairs. Classes that meet the least one of their bucket in two bands or more
    are compared with it, first with the one met most often. What then still meets across components is compared in full:
    the members of buckets of up to ``FEW`` as pairs, if they meet twice, and larger buckets in pairs of blocks of bounded
    size, which return spanning links and never pairs. No bucket is gathered whole.
    """
    named = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    rows, made = apart(named, "id", "text")
    found = _near_duplicates(rows.select("id", F.col("doc.text").alias("text")), made, width, percent)
    given = found if made is None else lookup_join(found, made, ["id"], "left").withColumn("id", F.coalesce("given", "id")).select("id", "n", "component")
    return given.withColumnRenamed("n", "n_shingles").withColumnRenamed("id", id_column)


def _near_duplicates(source: DataFrame, made: DataFrame | None, width: int, percent: int) -> DataFrame:
    """``id, n, component`` of rows whose ids have one text each; ``made`` ids belong with the given ones."""
    rows, bands = banding(percent)
    sketches = cut(source.mapInArrow(_sketch(width, rows, bands), f"id {dict(source.dtypes)['id']}, n long, lo long, hi long, keys array<long>"))
    able = sketches.where("n > 0 AND id IS NOT NULL")
    classes = able.groupBy("lo", "hi", "n").agg(F.min("id").alias("rep"))
    member = cut(able.select("id", "lo", "hi", "n").join(classes, ["lo", "hi", "n"]).select("id", "n", "rep"))
    copies = member.where("id != rep").select("id").join(member.select(F.col("rep").alias("id")), "id", "left_anti").distinct()
    meets = able.join(copies, "id", "left_anti").select(F.explode("keys").alias("key"), "id", "n")
    buckets = meets.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least != most")
    meets = cut(meets.join(buckets, "key").select("key", "id", "n", "least").distinct())
    # All comparisons need two meetings, so whoever was met in one bucket only is out. The texts of the rest are fetched once,
    # by a join that does not change its kind with the size of the input.
    often = meets.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id")
    meets = cut(meets.join(often, "id"))
    texts = cut(source.join(often.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"]))
    sizes = member.where("id = rep").select("id", "n").distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) of ids that hold."""
        left = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
        right = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
        read = pairs.join(right, "v").join(left, "u").select("u", "v", "text_u", "text_v")
        kind = dict(source.dtypes)["id"]
        return read.mapInArrow(_confirm(width, percent), f"u {kind}, v {kind}")

    def labelled(frame: DataFrame, groups: DataFrame, name: str, group: str) -> DataFrame:
        found = groups.select(F.col("id").alias(name), F.col("component").alias(group))
        return frame.join(found, name, "left").withColumn(group, F.coalesce(group, name))

    def alike(a: str, b: str):
        """Sets that differ too much in size cannot be linked."""
        return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)

    led = cut(meets.where("id != least").groupBy(F.col("least").alias("u"), F.col("id").alias("v")).agg(F.count("*").alias("times")).where("times > 1"))
    first = cut(led.groupBy("v").agg(F.max(F.struct("times", "u")).alias("most")).select(F.col("most.u").alias("u"), "v"))
    links = cut(confirmed(first))
    groups = cut(components(links))
    stars = labelled(labelled(led.join(first, ["u", "v"], "left_anti"), groups, "u", "gu"), groups, "v", "gv").where("gu != gv")
    for side in ("u", "v"):
        stars = stars.join(sizes.select(F.col("id").alias(side), F.col("n").alias("n" + side)), side)
    stars = cut(stars.where(alike("nu", "nv")).select("u", "v"))
    links = cut(links.union(confirmed(stars)))
    groups = cut(components(links))
    # Then whatever still meets across components.
    placed = labelled(meets.drop("least"), groups, "id", "g")
    mixed = placed.groupBy("key").agg(F.min("g").alias("a"), F.max("g").alias("b"), F.count("*").alias("members"), F.sum("n").alias("shingles")).where("a != b")
    placed = cut(placed.join(mixed.drop("a", "b"), "key"))
    small = placed.where(F.col("members") <= FEW)
    one, two = (small.select("key", *(F.col(c).alias(c + side) for c in ("id", "n", "g"))) for side in "uv")
    rest = one.join(two, "key").where("idu < idv AND gu != gv").where(alike("nu", "nv"))
    rest = rest.groupBy(F.col("idu").alias("u"), F.col("idv").alias("v")).agg(F.count("*").alias("times")).where("times > 1").select("u", "v")
    rest = cut(rest.join(first.union(stars), ["u", "v"], "left_anti"))
    large = placed.where(F.col("members") > FEW).withColumn("parts", F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)))
    large = large.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pieces = large.select("key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "id")
    kind = dict(source.dtypes)["id"]
    shingled = texts.join(pieces.select("id").distinct(), "id", "left_semi").mapInArrow(_sets(width), f"id {kind}, shingles array<long>")
    inside = pieces.join(shingled, "id").groupBy("key", "one", "two").applyInArrow(_blocked(percent), f"u {kind}, v {kind}")
    links = links.union(confirmed(rest)).union(inside)
    if made is not None:  # a made-up id and the given one are one document, though their texts need not be alike
        reps = member.select("id", "rep").distinct()
        own = made.join(reps, "id", "left").select(F.coalesce("rep", "id").alias("u"), F.col("given").alias("id")).join(reps, "id", "left")
        links = links.union(own.select("u", F.coalesce("rep", "id").alias("v")))
    groups = cut(components(cut(links)))

    found = member.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    rest = sketches.where("n = 0 OR id IS NULL").select("id", "n")
    if made is None:
        return found.union(rest.select("id", "n", F.col("id").alias("component")))
    return found.union(lookup_join(rest, groups, ["id"], "left").select("id", "n", F.coalesce("component", "id").alias("component")))


#: The same for three words and 85 per cent in plain SQL, every pair that shares a shingle counted.
COMPONENTS_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id AS id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS g
  FROM (SELECT r, id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, id, count(*) AS n FROM s GROUP BY r, id),
e AS (
  SELECT DISTINCT a.id AS u, b.id AS v
  FROM (SELECT a.r AS ra, b.r AS rb, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r != b.r AND a.id != b.id GROUP BY a.r, b.r)
  JOIN n a ON a.r = ra JOIN n b ON b.r = rb WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
reach(id, c) AS (SELECT DISTINCT id, id FROM d WHERE id IS NOT NULL UNION SELECT e.v, c FROM reach JOIN e ON e.u = reach.id),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT d.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, comp.c AS component_id, coalesce(d.id = comp.c, true) AS kept
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN comp ON comp.id = d.id
"""
