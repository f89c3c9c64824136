"""Near-duplicate texts and embeddings against all pairs."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from csvharbor.llm import components, embeddings, minhash
from tests.llm import brute


def near(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, component string, n long")
    return {r.doc_id: (r.n_shingles, r.component) for r in minhash.near_duplicates(df, **options).collect()}


def by_sql(sql, name, columns):
    """First three columns of the SQL's rows over a table of the given columns."""
    db = duckdb.connect()
    db.register(name, pa.table(columns))
    return sorted((r[:3] for r in db.execute(sql).fetchall()), key=str)


def vectors_by_sql(rows):
    ids, vectors, labels = zip(*rows, strict=True)
    columns = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}
    return by_sql(embeddings.COMPONENTS_SQL, "embeddings", columns)


def copies(seed, groups=6, size=14):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    shared = rng.choices(vocabulary, k=60)
    out = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([5, 40, 120, 300]))
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append(" ".join(text))
    out += [" ".join(rng.choices(vocabulary, k=rng.choice([15, 60])) + shared) for _ in range(25)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("few, rows, shingles", [(32, 1024, 500_000), (2, 5, 400), (2, 1000, 900)])
def test_documents_by_all_pairs(spark, monkeypatch, few, rows, shingles):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    data = copies(few + rows)
    assert near(spark, data, width=3, percent=85) == brute.near_duplicates(data, 3, 85)


def test_five_words_at_eighty_percent(spark):
    data = copies(11, groups=4)
    assert near(spark, data, width=5, percent=80) == brute.near_duplicates(data, 5, 80)


def test_odd_documents(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    data = [(5, None), (6, ""), (7, " \n\t"), (3, "one"), (9, "One"), (2, "one two"), (8, "ONE\ttwo "), (4, long), (1, long + " end"), (10, "a b c"), (11, "a  B c")]
    got = near(spark, data)
    assert got == brute.near_duplicates(data, 3, 85) and got[4][1] == 1 and got[9][1] == 3


def test_rows_that_repeat_or_have_no_id(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, None), (3, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (None, 0, None), (3, 1, 3)], key=str)


def test_texts_that_differ_under_one_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (2, b + " x"), (7, a + " y"), (9, c), (9, c), (9, None), (1, c + " z"), (6, ""), (6, "one two"), (8, "One TWO"), (None, a), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component) for r in minhash.near_duplicates(df).collect()), key=str)
    component = {5: 2, 2: 2, 7: 2, 9: 1, 1: 1, 6: 6, 8: 6, None: None}
    assert got == sorted(((i, len(brute.shingle_set(t, 3)), component[i]) for i, t in rows), key=str)
    ids, texts = zip(*rows, strict=True)
    assert got == by_sql(minhash.COMPONENTS_SQL, "documents", {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})


def test_no_documents(spark):
    assert near(spark, []) == {}


def test_bands_keep_what_they_promise():
    for percent in (80, 85, 95):
        rows, bands = minhash.banding(percent)
        p = (percent / 100) ** rows
        assert rows * bands <= minhash.COORDINATES and (1 - p) ** bands + bands * p * (1 - p) ** (bands - 1) <= 1e-6


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:2000], rng.integers(0, 1 << 63, 1000, dtype=np.uint64)]))
    one, two = minhash.signatures([a, b], 1000)
    assert abs((one == two).mean() - 0.5) < 0.06


def test_overlaps(monkeypatch):
    monkeypatch.setattr(minhash, "_COLUMNS", 3)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(-20, 20, rng.integers(1, 30))) for _ in range(12)]
    assert (minhash.overlaps(sets[:5], sets[5:]) == [[len(np.intersect1d(x, y)) for y in sets[5:]] for x in sets[:5]]).all()


def test_large_sets_are_counted_exactly():
    sets = [np.arange(795_293), np.arange(675_999)]
    both = minhash.overlaps(sets[:1], sets[1:])
    assert both[0, 0] == 675_999 and both.dtype == np.int64 and not (100 * both >= 85 * (795_293 + 675_999 - both)).any()


def close(spark, rows):
    df = spark.createDataFrame([(i, v, k, "x") for i, v, k in rows], "vec_id long, embedding array<float>, label int, n string")
    return sorted(((r.vec_id, r.n_links, r.component) for r in embeddings.near_duplicates(df).collect()), key=str)


def expected(rows):
    union, links = brute.Union(), {}
    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = {k: np.array(rows[k][1], np.float32).astype(float) for k in good}
    units = {k: v / np.linalg.norm(v) for k, v in units.items()}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.98:
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                union.join(rows[a][0], rows[b][0])
    return sorted(((i, links.get(k, 0), None if i is None else union.find(i) if k in good else i) for k, (i, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [512, 4])
def test_vectors_by_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    rng = np.random.default_rng(block)
    rows = []
    for group in range(12):
        base = rng.standard_normal(64)
        for _ in range(10):
            rows.append((len(rows), (base + rng.standard_normal(64) * rng.choice([0, 0.05, 0.12, 0.16])).tolist(), group % 3))
    rows += [(len(rows) + k, rng.standard_normal(64).tolist(), k % 3) for k in range(30)]
    assert close(spark, rows) == expected(rows)


def test_odd_vectors(spark):
    v, w = [1.0, 2.0, 0.5], [1.0, 2.0, 0.51]
    rows = [
        (1, v, 0), (2, v, 0), (3, w, 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0] * 3, 0), (8, [1.0, None, 2.0], 0), (9, [1.0, float("nan"), 2.0], 0),
        (10, [float("inf"), 1.0, 2.0], 0), (11, [1e30, 2e30, 0.5e30], 0), (12, [1.0, 2.0], 0), (13, [], 0), (None, v, 0),
    ]
    got = close(spark, rows)
    assert got == expected(rows) and (1, 3, 1) in got
    assert got == vectors_by_sql(rows)


def test_vectors_that_differ_under_one_id(spark):
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.1], [0.1, 0.0, 1.0]
    rows = [(1, a, 0), (5, a, 0), (5, b, 0), (9, b, 0), (9, b, 0), (5, None, 0), (7, None, 0), (7, None, 0), (8, c, 0), (8, c, 1), (3, c, 1), (None, a, 0), (4, [0.0] * 3, 0)]
    got = close(spark, rows)
    links = [(1, 1, 1), (5, 1, 1), (5, 2, 1), (9, 2, 1), (9, 2, 1), (5, 0, 1), (7, 0, 7), (7, 0, 7), (8, 0, 3), (8, 1, 3), (3, 1, 3), (None, 0, None), (4, 0, 4)]
    assert got == sorted(links, key=str) == vectors_by_sql(rows)


def test_no_vectors(spark):
    assert close(spark, []) == []


def test_no_link_at_all(spark):
    rows = [(k, np.eye(8)[k].tolist(), 0) for k in range(8)]
    assert close(spark, rows) == expected(rows)


def test_stars_need_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "cut", lambda df, cut=components.cut: written.append(1) or cut(df))
    links = lambda *pairs: spark.createDataFrame(pairs, "u long, v long")
    found = lambda *pairs: sorted(tuple(r) for r in components.components(links(*pairs)).collect())
    assert found((5, 1), (1, 9), (8, 2), (5, 1), (3, 3)) == [(1, 1), (2, 2), (5, 1), (8, 2), (9, 1)] and len(written) == 1
    assert found((1, 2), (2, 3), (7, 3), (7, 9), (4, 8)) == [(1, 1), (2, 1), (3, 1), (4, 4), (7, 1), (8, 4), (9, 1)]
    assert components.components(links((1, 1))).count() == 0
