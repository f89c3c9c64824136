"""Hard negatives by exact search through an R-tree packed by sorting and tiling.

Rows of one label are sorted by their widest coordinate and cut into slabs, these by the next one, and so on; neighbours in
the last order share a page, pages a node, nodes a branch. Every box has the least and greatest value of each coordinate, so
the inner products of an anchor with all rows below lie in an interval. Anchors in blocks meet the branches whose interval
reaches one of their score windows; within a branch a queue opens the box with the highest bound first, and leaves out boxes
beside the windows and those strictly below the last place held so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csvharbor.llm.ranks import numbered
from csvharbor.operators.joins import small_side
from csvharbor.session import cut

PAGE = 32
FAN = 8
BRANCH = PAGE * FAN * FAN
PACK = 256
BLOCK = 512
AXES = 3
EXACT = 2.0**51
LONG = 2**63 - 1
Boxes = list[tuple[np.ndarray, np.ndarray]]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers kept as doubles: exact, by Python's integers where doubles are too short."""
    most = (np.abs(a).max(initial=0) + 1) * (np.abs(b).max(initial=0) + 1) * max(a.shape[1], 1)
    if most < EXACT:
        return a @ b.T
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.array(whole(a) @ whole(b).T, object).reshape(len(a), len(b))


def intervals(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per box and anchor the least and the greatest inner product that a row in the box can have."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(lo, up) + products(hi, down), products(hi, up) + products(lo, down)


def boxes(vectors: np.ndarray) -> Boxes:
    """Boxes of pages, then of nodes of ``FAN`` boxes each, up to one."""
    lo = hi = vectors
    step, levels = PAGE, []
    while not levels or len(lo) > 1:
        starts = np.arange(0, len(lo), step)
        lo, hi = np.minimum.reduceat(lo, starts, axis=0), np.maximum.reduceat(hi, starts, axis=0)
        levels.append((lo, hi))
        step = FAN
    return levels


class Branch:
    """The rows of a branch with its boxes, for the anchors of one block."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, anchors: np.ndarray):
        self.vectors, self.ids, self.rows, self.anchors = vectors, ids, rows, anchors
        self.bounds = [intervals(anchors, lo, hi) for lo, hi in boxes(vectors)]
        self.pages: dict[int, np.ndarray] = {}

    def scores(self, page: int) -> np.ndarray:
        if page not in self.pages:
            self.pages[page] = products(self.anchors, self.vectors[page * PAGE : (page + 1) * PAGE])
        return self.pages[page]

    def best(self, anchor: int, row: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """Per window (least and greatest score) the first k rows but ``row`` itself, as (-score, id)."""
        found: list[list] = [[] for _ in windows]
        floor, roof = [lo for lo, _ in windows], max(hi for _, hi in windows)
        top = len(self.bounds) - 1
        queue = [(-self.bounds[top][1][0, anchor], top, 0)]
        while queue:
            bound, level, node = heapq.heappop(queue)
            if -bound < min(floor):
                break
            if self.bounds[level][0][node, anchor] > roof:
                continue
            if level:
                highest = self.bounds[level - 1][1]
                for child in range(node * FAN, min((node + 1) * FAN, len(highest))):
                    heapq.heappush(queue, (-highest[child, anchor], level - 1, child))
                continue
            scores, at = self.scores(node)[anchor], node * PAGE
            other = self.rows[at : at + PAGE] != row
            for w, (_, hi) in enumerate(windows):
                for i in np.flatnonzero((scores >= floor[w]) & (scores <= hi) & other).tolist():
                    found[w].append((-int(scores[i]), int(self.ids[at + i])))
                if len(found[w]) >= k:
                    found[w] = sorted(found[w])[:k]
                    floor[w] = max(floor[w], -found[w][-1][0])
        return [sorted(f)[:k] for f in found]


def _matrix(batch: pa.RecordBatch, name: str, k: int, dims: int, n: int) -> np.ndarray:
    return batch.column(name)[k].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dims)


def _array(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return batch.column(name)[k].values.to_numpy(zero_copy_only=False)


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lows, highs = [], []
        for k in range(batch.num_rows):
            vectors = _matrix(batch, "vectors", k, batch.column("dims")[k].as_py(), len(batch.column("ids")[k]))
            lows.append(vectors.min(0)), highs.append(vectors.max(0))
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("dims", "serial", "label")), pa.array(lows, kind), pa.array(highs, kind)], ["dims", "serial", "label", "lo", "hi"])


def window(score: int, low: int) -> tuple[int, int]:
    """Least and greatest score of a negative, for ``low`` per cent of a positive's score."""
    return -(-low * score // 100), score


def _reached(low: int):
    """Pairs of anchor block and branch: own labels without ``scores``, else other labels whose interval meets a window."""

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for k in range(batch.num_rows):
                of = lambda c: batch.column(c)[k].as_py()  # noqa: B023, E731
                dims, serials, theirs, mine = of("dims"), of("serials"), of("their_labels"), of("labels")
                alike = np.array([[a == b for a in mine] for b in theirs], bool)
                if batch.schema.get_field_index("scores") < 0:
                    meets = alike.any(1)
                else:
                    n = len(serials)
                    least, most = intervals(_matrix(batch, "vectors", k, dims, len(mine)), _matrix(batch, "lo", k, dims, n), _matrix(batch, "hi", k, dims, n))
                    meets = np.zeros(n, bool)
                    for a, scores in enumerate(of("scores")):
                        for lo, hi in (window(s, low) for s in scores):
                            if lo <= hi:
                                meets |= ~alike[:, a] & (least[:, a] <= hi) & (most[:, a] >= lo)
                out += [(dims, of("block"), s) for s, m in zip(serials, meets, strict=True) if m]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["dims", "block", "serial"])

    return reached


FOUND = "anchor long, anchor_id long, k int, id long, score long"


def _searched(many: int, low: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dims, label, labels = batch.column("dims")[k].as_py(), batch.column("label")[k].as_py(), batch.column("labels")[k].as_py()
                ids, rows, anchor_ids, anchors = (_array(batch, c, k) for c in ("ids", "rows", "anchor_ids", "anchors"))
                branch = Branch(_matrix(batch, "vectors", k, dims, len(ids)), ids, rows, _matrix(batch, "anchor_vectors", k, dims, len(anchors)))
                given = batch.column("scores")[k].as_py() if batch.schema.get_field_index("scores") >= 0 else None
                out: list[tuple] = []
                for a in range(len(anchors)):
                    if (labels[a] == label) != (given is None):
                        continue
                    asked = [(0, (-np.inf, np.inf))] if given is None else [(i, w) for i, w in enumerate(window(s, low) for s in given[a]) if w[0] <= w[1]]
                    if asked:
                        best = branch.best(a, anchors[a], [w for _, w in asked], many)
                        out += [(int(anchors[a]), int(anchor_ids[a]), i, j, max(-LONG, min(LONG, -s))) for (i, _), b in zip(asked, best, strict=True) for s, j in b]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["anchor", "anchor_id", "k", "id", "score"])

    return searched


def tiled(rows: DataFrame, axes: int = AXES) -> DataFrame:
    """Rows (``dims, label, row`` and coordinates ``c0, c1, ...``) with their place in the packed order of their label."""
    by, slabs = ["dims", "label"], []
    for k in range(axes - 1):
        rows = numbered(rows, [*by, *slabs], [f"c{k}", "row"])
        pages = F.ceil(F.col("total") / PAGE)
        cuts = F.ceil(F.pow(pages, F.lit(1.0 / (axes - k))))
        rows = rows.withColumn(f"s{k}", F.floor(F.col("place") / (F.ceil(pages / cuts) * PAGE))).drop("place", "total")
        slabs.append(f"s{k}")
    return numbered(rows, by, [*slabs, f"c{axes - 1}", "row"]).select(*by, "row", "place")


def _blocks(anchors: DataFrame, more: list[str]) -> DataFrame:
    """Anchors in blocks of ``BLOCK`` at most, neighbours by label."""
    placed = numbered(anchors, ["dims"], ["label", "id", "row"])
    rows = F.sort_array(F.collect_list(F.struct("place", "row", "id", "label", "vector", *more)))
    packed = placed.groupBy("dims", F.floor(F.col("place") / BLOCK).alias("block")).agg(rows.alias("r"))
    return cut(packed.select(
        "dims", "block", F.col("r.row").alias("anchors"), F.col("r.id").alias("anchor_ids"), F.col("r.label").alias("labels"),
        F.flatten("r.vector").alias("anchor_vectors"), *[F.col(f"r.{c}").alias(c) for c in more],
    ))


def hard_negatives(
    rows: DataFrame, anchor: Column, ident: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; components must be whole numbers.

    Higher inner products come first, ties by smaller id. An anchor's positives are its first other rows of the same label;
    for each, the first rows of other labels whose score is at most the positive's and at least ``low`` per cent of it.
    Rows without an id, label or vector, or with a null or non-finite component, take no part; rows meet only rows whose
    vector has as many components. Repeated rows count one by one, a copy of an anchor is another row. Scores are exact and
    shown as the nearest long. Without rows or anchors the result is empty. Other columns are not looked at.
    """
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = rows.where(F.col(ident).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & sound)
    whole = whole.select(
        F.col(ident).cast("long").alias("id"), F.col(label).alias("label"), F.size(vector).alias("dims"), F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row"),
    )
    whole = cut(whole)
    spread = whole.select("dims", F.posexplode("vector").alias("axis", "x")).groupBy("dims", "axis").agg(F.var_pop("x").alias("v"))
    widest = F.row_number().over(Window.partitionBy("dims").orderBy(F.desc("v"), "axis"))
    axes = spread.withColumn("k", widest).where(F.col("k") <= AXES).groupBy("dims").agg(F.sort_array(F.collect_list(F.struct("k", "axis"))).alias("axes"))
    sorted_by = [F.coalesce(F.get("vector", F.get("axes.axis", F.lit(k))), F.lit(0.0)).alias(f"c{k}") for k in range(AXES)]
    light = whole.join(small_side(cut(axes)), "dims", "left").select("dims", "label", "row", *sorted_by)
    packed = tiled(light).withColumn("branch", F.floor(F.col("place") / BRANCH))
    below = F.sort_array(F.collect_list(F.struct("place", "row", "id", "vector"))).alias("r")
    grouped = cut(packed.drop("label", "dims").join(whole, "row").groupBy("dims", "label", "branch").agg(below))
    serials = numbered(grouped.select("dims", "label", "branch"), ["dims"], ["label", "branch"]).withColumnRenamed("place", "serial")
    branches = grouped.join(small_side(cut(serials)), ["dims", "label", "branch"]).select(
        "dims", "serial", "label", F.col("r.row").alias("rows"), F.col("r.id").alias("ids"), F.flatten("r.vector").alias("vectors")
    )
    branches = cut(branches)
    kind = dict(whole.dtypes)["label"]
    boxed = branches.mapInArrow(_boxed, f"dims int, serial long, label {kind}, lo array<double>, hi array<double>")
    in_pack = F.sort_array(F.collect_list(F.struct("serial", "label", "lo", "hi"))).alias("r")
    packs = boxed.groupBy("dims", F.floor(F.col("serial") / PACK).alias("pack")).agg(in_pack).select(
        "dims", "pack", F.col("r.serial").alias("serials"), F.col("r.label").alias("their_labels"), F.flatten("r.lo").alias("lo"), F.flatten("r.hi").alias("hi")
    )
    packs = cut(packs)
    sizes = packs.groupBy("dims").agg(F.max("pack").alias("last"))

    def found(blocks: DataFrame, many: int) -> DataFrame:
        """The first rows per anchor and score window, over all branches that the boxes do not rule out."""
        scores = [c for c in ("scores",) if c in blocks.columns]
        asked = blocks.select("dims", "block", "labels", F.col("anchor_vectors").alias("vectors"), *scores)
        met = asked.join(small_side(sizes), "dims").withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).join(packs, ["dims", "pack"])
        pairs = cut(met.mapInArrow(_reached(low), "dims int, block long, serial long"))
        work = pairs.join(blocks, ["dims", "block"]).join(branches, ["dims", "serial"])
        order = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "id")
        return work.mapInArrow(_searched(many, low), FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= many)

    anchors = whole.where("anchor").select("dims", "label", "id", "row", "vector")
    nearest = cut(found(_blocks(anchors, []), positives))
    first = nearest.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    held = cut(anchors.join(first.select("row", F.col("p.id").alias("positives"), F.col("p.score").alias("scores")), "row"))
    blocks = _blocks(held, ["scores"])
    chosen = found(blocks, negatives)
    named = held.select(F.col("row").alias("anchor"), F.posexplode(F.arrays_zip("positives", "scores")).alias("k", "p"))
    return chosen.join(named, ["anchor", "k"]).select(
        "anchor_id", F.col("p.positives").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.scores").alias("positive_score"), F.col("score").alias("negative_score")
    )


#: The same over ``embeddings`` by all pairs, with labels and components as the query prepares them.
NEGATIVES_SQL = """
WITH s AS (
  SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
m AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label AS mine, b.vec_id AS id, b.label AS theirs,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM s a JOIN s b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS k FROM m WHERE mine = theirs QUALIFY k <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.r, p.k ORDER BY m.score DESC, m.id) AS rank, m.id AS negative_id,
    p.score AS positive_score, m.score AS negative_score
  FROM p JOIN m ON m.r = p.r AND m.mine <> m.theirs AND 80 * p.score <= 100 * m.score AND m.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
