"""The manifest's trees and proofs against trees built one node at a time."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from csvharbor.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([h(*row[k : k + 2]) for k in range(0, len(row), 2)])
    return levels


def siblings(levels, place):
    out = []
    for row in levels[:-1]:
        if place ^ 1 < len(row):
            out.append(row[place ^ 1])
        place >>= 1
    return out


@pytest.mark.parametrize("total", [1, 2, 3, 5, 8, 13, 31, 64, 100])
def test_multiproof_has_no_node_too_many(total):
    levels = tree([h(str(k)) for k in range(total)])
    for seed in range(5):
        places = random.Random(seed).sample(range(total), random.Random(seed).randint(1, total))
        asked = merkle.missing(places, total)
        assert len(set(asked)) == len(asked) and all(node < len(levels[level]) for level, node in asked)
        nodes = {(0, p): levels[0][p] for p in places} | {(level, k): levels[level][k] for level, k in asked}
        assert merkle.derive(nodes, places, total) == levels[-1][0]
        for p in places:
            proof = merkle.path(nodes, p, total)
            assert proof == siblings(levels, p) and merkle.fold(levels[0][p], iter(proof), p, total) == levels[-1][0]
        for gone in asked:  # every one of them is needed
            fewer = {(0, p): levels[0][p] for p in places} | {(level, k): levels[level][k] for level, k in asked if (level, k) != gone}
            with pytest.raises(KeyError):
                merkle.derive(fewer, places, total)


def expected(rows, leaf, claimed):
    """Sorted (id, leaf, subroot, root, proof, folded) by plain trees."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], leaf(row), claimed(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, members = {}, {}
    for name in names:
        members[name] = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = tree([m[1] for m in members[name]])
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for rank, name in enumerate(names):
        n = len(members[name])
        for place, (ident, own, told) in enumerate(members[name]):
            proof = siblings(trees[name], place) + siblings(top, rank)
            rest = iter(proof)
            folded = merkle.fold(merkle.fold(told, rest, place, n), rest, rank, len(names))
            out.append((ident, own, trees[name][-1][0], top[-1][0], proof, folded))
    return sorted(out, key=str)


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return h(part(row[0]), part(row[1]), part(row[2]))


ODD = [
    (3, "en", "a"), (1, "en", "ü"), (2, None, ""), (None, "en", None), (None, None, "x"), (7, "", "y"), (7, "", "y"), (7, "", "z"),
    (9, "é", "long " * 50_000), (8, "zz", "1"), (-5, "en", "a"), (5, "-", "b"), (6, "/", "c"),
]


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_every_row_is_proved(spark, bits):
    many = [(k, ["en", "de", None][k % 3] if k % 10 else "fr", f"text {k % 17}") for k in range(300)]
    for rows in (ODD, many, ODD[:1]):
        df = spark.createDataFrame([(*r, 1, "t") for r in rows], "n long, kind string, body string, place int, tree string")
        leaf = merkle.leaf_digest([F.col("n"), F.col("kind"), F.col("body")])
        found = merkle.prove(merkle.build(df, "n", "kind", leaf, bits=bits)).collect()
        assert sorted((tuple(r) for r in found), key=str) == expected(rows, leaf_of, leaf_of)
        assert all(r.folded_root == r.root for r in found)


def test_claims_that_differ_are_found(spark):
    rows = [(k, "en" if k % 4 else None, f"t{k}") for k in range(120)]
    df = spark.createDataFrame(rows, "n long, kind string, body string")
    leaf = merkle.leaf_digest([F.col("n"), F.col("kind"), F.col("body")])
    told = merkle.leaf_digest([F.col("n"), F.col("kind"), F.when(F.col("n") % 9 == 0, "forged").otherwise(F.col("body"))])
    found = merkle.prove(merkle.build(df, "n", "kind", leaf, told, bits=3)).collect()
    forged = lambda r: leaf_of((*r[:2], "forged" if r[0] % 9 == 0 else r[2]))
    assert sorted((tuple(r) for r in found), key=str) == expected(rows, leaf_of, forged)
    assert {r.id for r in found if r.folded_root != r.root} == {k for k in range(120) if k % 9 == 0}


def test_some_leaves_only(spark):
    rows = [(k, "en", f"t{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "n long, kind string, body string")
    made = merkle.build(df, "n", "kind", merkle.leaf_digest([F.col("n"), F.col("kind"), F.col("body")]), bits=3)
    found = merkle.prove(made, made.leaves.where("id % 23 = 4 OR id IN (100, 101, 199)")).collect()
    wanted = [r for r in expected(rows, leaf_of, leaf_of) if r[0] % 23 == 4 or r[0] in (100, 101, 199)]
    assert sorted((tuple(r) for r in found), key=str) == wanted


def test_empty_table(spark):
    none = spark.createDataFrame([], "n long, kind string")
    assert merkle.prove(merkle.build(none, "n", "kind", merkle.leaf_digest([F.col("n")]))).collect() == []
