"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from csvharbor.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, serial int, row string, place int"


def brute(rows, positives=5, many=5, low=80):
    """Sorted (anchor, positive, rank, negative, positive score, negative score)."""
    sound = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    whole = [(i, [int(x) for x in v], label) for i, v, label in sound]
    out = []
    for k, (i, v, label) in enumerate(whole):
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for n, (j, w, other) in enumerate(whole) if n != k and len(w) == len(v)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fit = sorted((ns, n) for ns, n, other in scored if other != label and 80 * -ps <= 100 * -ns <= 100 * -ps)
            out += [(i, p, rank + 1, n, -ps, -ns) for rank, (ns, n) in enumerate(fit[:many])]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "r", 2) for i, v, label in rows], SCHEMA)
    found = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def clustered(seed, n, dims=12, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 60, (6, dims))
    return [(int(k), np.floor(centres[rng.integers(6)] + rng.normal(0, 9, dims)).tolist(), int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("branch, block, pack", [(negatives.BRANCH, negatives.BLOCK, negatives.PACK), (64, 3, 2)])
def test_all_pairs(spark, monkeypatch, branch, block, pack):
    monkeypatch.setattr(negatives, "BRANCH", branch)
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "PACK", pack)
    rows = clustered(3, 900)
    found = mined(spark, rows)
    assert found == brute(rows) and found


def test_odd_rows(spark):
    rows = [
        (100, [1, 2], 0), (100, [1, 2], 0), (1, [1, 2], 0), (2, [1, 2], 1), (3, [1, 2], 1), (3, [1, 2], 1), (4, None, 1), (5, [1, None], 1),
        (6, [float("inf"), 1], 1), (7, [float("nan"), 1], 1), (None, [1, 2], 1), (8, [1, 2], None), (9, [1, 2, 3], 1), (200, [1, 2, 3], 0), (10, [], 0),
        (300, [], 0), (11, [], 2), (400, [-3, -3], 5), (12, [3, 3], 5), (13, [2, 3], 0), (500, [0, 0], 7), (14, [5, 5], 7), (15, [0, 1], 8),
    ]
    assert mined(spark, rows) == brute(rows)


def test_equal_scores_take_the_smaller_ids(spark):
    rows = [(k, [2, 1], 0 if k % 2 else 1) for k in range(150)]
    assert mined(spark, rows) == brute(rows)


def test_large_numbers_stay_exact(spark):
    big = 2**30
    rows = [(100, [big, 1, 3], 0), (1, [big, 5, 0], 0), (2, [big, 4, 0], 1), (3, [big, 5, 0], 1), (4, [big, 5, 1], 1), (5, [big, -7, 0], 1), (6, [-big, 5, 0], 1)]
    assert mined(spark, rows) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []


def test_bounds_hold_and_boxes_are_left_out():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 100, (40, 6))
    vectors = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(0, 2, (2000, 6)))
    anchors = np.floor(centres[:8])
    for lo, hi in negatives.boxes(vectors):
        step = -(-len(vectors) // len(lo))
        assert len(lo) == 1 or step >= negatives.PAGE
    branch = negatives.Branch(vectors, np.arange(2000), np.arange(2000), anchors)
    for a in range(8):
        least, most = branch.bounds[0]
        for page in range(len(least)):
            scores = branch.scores(page)[a]
            assert least[page, a] <= scores.min() and scores.max() <= most[page, a]
    branch.pages.clear()
    scores = vectors @ anchors[0]
    best = branch.best(0, -1, [(-np.inf, np.inf), (int(scores.max() * 0.5), int(scores.max() * 0.6))], 5)
    order = sorted((-int(s), k) for k, s in enumerate(scores))
    inside = [o for o in order if int(scores.max() * 0.5) <= -o[0] <= int(scores.max() * 0.6)]
    assert best == [order[:5], inside[:5]] and len(branch.pages) < len(branch.bounds[0][0]) / 2
