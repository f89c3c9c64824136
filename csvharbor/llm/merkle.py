"""Merkle manifest of a dataset with octopus multiproofs.

Every group of rows has a binary hash tree over its rows in order, and a top tree stands over the groups' roots. Trees are
built upwards in blocks of ``2 ** BITS`` neighbouring nodes, so that a group of any size takes a few rounds of small tasks.
A proof is made per block: the block asks only for those nodes that its own rows do not give, each once, derives the nodes
inside, and unfolds from both the siblings of every single row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.llm.ranks import numbered
from csvharbor.operators.joins import lookup_join, small_side
from csvharbor.session import cut

BITS = 10
TOP = "/"
NODE = "tree string, total long, level int, idx long, digest string"
Nodes = dict[tuple[int, int], str]


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(total: int) -> int:
    """Levels above the leaves of a tree."""
    return (total - 1).bit_length()


def above(nodes: list[str]) -> list[str]:
    """A level from the one below it; an odd node at the end is hashed alone."""
    return [digest(nodes[k : k + 2]) for k in range(0, len(nodes), 2)]


def missing(places: Iterable[int], total: int) -> list[tuple[int, int]]:
    """The least set of nodes (level, index) that give the root together with the leaves at these places."""
    known, out, level = set(places), [], 0
    while total > 1:
        out += [(level, k ^ 1) for k in sorted(known) if k ^ 1 < total and k ^ 1 not in known]
        known, total, level = {k >> 1 for k in known}, (total + 1) // 2, level + 1
    return out


def derive(nodes: Nodes, places: Iterable[int], total: int) -> str:
    """The root; ``nodes`` has the leaves at these places and the missing nodes, and gets those between."""
    known, level = set(places), 0
    while total > 1:
        known = {k >> 1 for k in known}
        for k in known:
            nodes[level + 1, k] = digest(nodes[level, i] for i in (2 * k, 2 * k + 1) if i < total)
        total, level = (total + 1) // 2, level + 1
    return nodes[level, 0]


def path(nodes: Nodes, place: int, total: int) -> list[str]:
    """The siblings from a leaf to the root."""
    out, level = [], 0
    while total > 1:
        if place ^ 1 < total:
            out.append(nodes[level, place ^ 1])
        place, total, level = place >> 1, (total + 1) // 2, level + 1
    return out


def fold(leaf: str, siblings: Iterator[str], place: int, total: int) -> str:
    """The root that a leaf and its siblings give."""
    while total > 1:
        if place ^ 1 < total:
            other = next(siblings)
            leaf = digest((other, leaf) if place & 1 else (leaf, other))
        else:
            leaf = digest((leaf,))
        place, total = place >> 1, (total + 1) // 2
    return leaf


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 over the values as text, each behind its number of bytes; ``-`` stands for a null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _risen(bits: int):
    def risen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for tree, total, level, first, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for up in range(1, min(bits, height(total) - level) + 1):
                    nodes, first = above(nodes), first >> 1
                    rows += [(tree, total, level + up, first + k, node) for k, node in enumerate(nodes)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "total", "level", "idx", "digest"])

    return risen


def grown(leaves: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """All nodes of trees over leaves (``tree, total, level`` 0, ``idx, digest``), a written table per round of ``bits`` levels."""
    tallest = leaves.agg(F.max("total")).first()[0]
    frontier, rounds = leaves, [leaves]
    for level in range(0, height(tallest or 1), bits):
        open_ = frontier.where((F.col("level") == level) & (F.col("total") > F.shiftleft(F.lit(1).cast("long"), level)))
        block = F.shiftright("idx", bits)
        packed = open_.groupBy("tree", "total", "level", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("n"))
        packed = packed.select("tree", "total", "level", F.shiftleft("block", bits).alias("first"), F.col("n.digest").alias("nodes"))
        frontier = cut(packed.mapInArrow(_risen(bits), NODE))
        rounds.append(frontier)
    return rounds


@dataclass(frozen=True)
class Manifest:
    """``leaves``: tree, place, total, id, digest, claimed. ``lower``, ``upper``: nodes. ``roots``: tree, rank, trees, subroot, root."""

    leaves: DataFrame
    lower: DataFrame
    upper: DataFrame
    roots: DataFrame
    bits: int


def build(rows: DataFrame, ident: str, group: str, leaf: Column, claimed: Column | None = None, bits: int = BITS) -> Manifest:
    """The trees over a table's rows: one per value of ``group`` in order of ``ident``, and one over their roots.

    Null groups are one group and come first, groups stand in the bytewise order of their names; null ids come first. Rows
    that share an id stand in order of their leaves, so equal rows are interchangeable. An empty table has no tree. Other
    columns are not looked at unless the leaf uses them; ``claimed`` is a leaf shown instead of the row's own, to be verified.
    """
    tree = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    chosen = rows.select(tree.alias("tree"), F.col(ident).alias("id"), leaf.alias("digest"), (claimed if claimed is not None else leaf).alias("claimed"))
    chosen = cut(chosen.withColumn("row", F.monotonically_increasing_id()))
    leaves = cut(numbered(chosen, ["tree"], ["id", "digest", "row"]).drop("row"))
    of_leaves = leaves.select("tree", "total", F.lit(0).alias("level"), F.col("place").alias("idx"), "digest")
    rounds = grown(of_leaves, bits)
    all_nodes = _union(rounds)
    subroots = all_nodes.where("idx = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))
    ranked = cut(numbered(cut(subroots.withColumn("one", F.lit(0))), ["one"], ["tree"]))
    tops = grown(ranked.select(F.lit(TOP).alias("tree"), "total", F.lit(0).alias("level"), F.col("place").alias("idx"), "digest"), bits)
    root = _union(tops).where("idx = 0").agg(F.max_by("digest", "level")).first()[0]
    roots = cut(ranked.select("tree", F.col("place").alias("rank"), F.col("total").alias("trees"), F.col("digest").alias("subroot"), F.lit(root).alias("root")))
    low = F.col("level") < bits
    return Manifest(leaves, all_nodes.where(low), _union([*rounds[1:], *tops]).where(~low | (F.col("tree") == TOP)), roots, bits)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for tree, block, total, rank, trees, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [(tree, block, tree, level, k) for level, k in missing(places, total)]
            rows += [(tree, block, TOP, level, k) for level, k in missing([rank], trees)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "block", "node", "level", "idx"])


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["tree", "total", "rank", "trees", "subroot", "root", "place", "digest", "claimed", "fetched"]
    for batch in batches:
        for k in range(batch.num_rows):
            of = {n: batch.column(n)[k].as_py() for n in names}
            total, places, leaves = of["total"], of["place"], of["digest"]
            own: Nodes = {(0, p): leaf for p, leaf in zip(places, leaves, strict=True)}
            top: Nodes = {}
            for node in of["fetched"] or []:
                (top if node["node"] == TOP else own)[node["level"], node["idx"]] = node["digest"]
            top[0, of["rank"]] = derive(own, places, total)
            derived = derive(top, [of["rank"]], of["trees"])
            end = path(top, of["rank"], of["trees"])
            proofs = [path(own, p, total) + end for p in places]
            folded = []
            for place, leaf, claimed, proof in zip(places, leaves, of["claimed"], proofs, strict=True):
                if claimed == leaf:  # the nodes above it are those of the derived root
                    folded.append(derived)
                    continue
                siblings = iter(proof)
                folded.append(fold(fold(claimed, siblings, place, total), siblings, of["rank"], of["trees"]))
            n = len(places)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")[k].values, *(pa.array(x, pa.string()) for x in (leaves, [of["subroot"]] * n, [of["root"]] * n)),
                 pa.array(proofs, pa.list_(pa.string())), pa.array(folded, pa.string())],
                ["id", "leaf", "subroot", "root", "proof", "folded_root"],
            )


def prove(manifest: Manifest, chosen: DataFrame | None = None) -> DataFrame:
    """``id, leaf, subroot, root, proof, folded_root`` for the chosen leaves (rows of ``manifest.leaves``), or for all.

    ``proof`` lists the siblings from the leaf through the root of its group to the root, left out where a node has none.
    ``folded_root`` is what the claimed leaf and these siblings give: it equals ``root`` if and only if the claim is right.
    """
    picked = manifest.leaves if chosen is None else chosen
    block = F.shiftright("place", manifest.bits).alias("block")
    # A block has 2 ** bits rows at most.
    packed = picked.groupBy("tree", "total", block).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "claimed", "id"))).alias("r"))
    packed = packed.select("tree", "total", "block", *[F.col(f"r.{c}").alias(c) for c in ("place", "digest", "claimed", "id")])
    blocks = cut(packed.join(small_side(manifest.roots), "tree"))
    asked = blocks.select("tree", "block", "total", "rank", "trees", "place").mapInArrow(_asked, "tree string, block long, node string, level int, idx long")
    asked = cut(asked)
    high = (F.col("level") >= manifest.bits) | (F.col("node") == TOP)
    at, found = ["node", "level", "idx"], []
    for part, nodes in ((asked.where(high), manifest.upper), (asked.where(~high), manifest.lower)):
        if not part.isEmpty():
            found.append(lookup_join(part, nodes.select(F.col("tree").alias("node"), "level", "idx", "digest"), at))
    empty = asked.limit(0).withColumn("digest", F.lit(""))
    fetched = _union([empty, *found]).groupBy("tree", "block").agg(F.collect_list(F.struct(*at, "digest")).alias("fetched"))
    ready = blocks.join(small_side(cut(fetched)), ["tree", "block"], "left")
    kind = dict(manifest.leaves.dtypes)["id"]
    return ready.mapInArrow(_proved, f"id {kind}, leaf string, subroot string, root string, proof array<string>, folded_root string")


#: The manifest of ``documents`` in plain SQL: levels by recursion, CRC-32 bit by bit, claims folded level by level.
MANIFEST_SQL = """
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS r, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
  FROM documents),
f AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS told FROM d),
h AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(told::VARCHAR) || ':' || told, '-') || tail) AS claimed FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h),
nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS node FROM p
  UNION ALL
  SELECT lang, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2),
sub AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, subroot AS node FROM sub
  UNION ALL
  SELECT level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2),
walk AS (
  SELECT r, lang, 0 AS level, i, n, claimed AS node, '' AS proof FROM p
  UNION ALL
  SELECT w.r, w.lang, w.level + 1, w.i // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.i % 2 = 1 THEN s.node || w.node ELSE w.node || coalesce(s.node, '') END), w.proof || coalesce(s.node, '')
  FROM walk w LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1),
climb AS (
  SELECT r, 0 AS level, sub.i, sub.n, node, proof FROM walk JOIN sub ON sub.lang IS NOT DISTINCT FROM walk.lang WHERE walk.n = 1
  UNION ALL
  SELECT w.r, w.level + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN s.node || w.node ELSE w.node || coalesce(s.node, '') END), w.proof || coalesce(s.node, '')
  FROM climb w LEFT JOIN tops s ON s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, root.node AS root, sha256(proof) AS proof_sha256, climb.node AS folded_root, climb.node = root.node AS verified
FROM climb JOIN p USING (r) JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT node FROM tops WHERE n = 1) root WHERE climb.n = 1
"""
