"""Operator 13: a Merkle manifest of a dataset, with persistent versions for altered rows.

Every row is a leaf; the leaves of a source, in the order of their ids, are the
bottom of that source's tree, and the sources' roots are the leaves of the tree
above.  Sixteen consecutive nodes have one parent.

A tree is cut into aligned blocks of 16 ** 3 nodes, one task group
each, so the largest group is bounded whatever a source's share of the rows.
Upwards, a block leaves one node for the next round of blocks; downwards, a
block's node gets the siblings on its way to the root, which its own nodes'
ways continue.  A block's tree is persistent: an altered leaf makes a version
that copies the leaf's ancestors inside the block and shares every other node;
the version's root then goes on along the block's way to the dataset's root, so
each version costs one node a level.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulus.llm.staging import numbered, staged

FAN = 16            # nodes under one parent
BLOCK_LEVELS = 3    # levels of a tree that one task group builds
DIGEST = 64         # characters of a digest

PATH = "array<struct<place: int, siblings: string>>"


class Node(NamedTuple):
    digest: str
    children: tuple


class Step(NamedTuple):
    """One level on the way up: a node's place in its run and the run's other digests."""
    place: int
    siblings: str


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """H of the columns: each as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    parts = []
    for c in columns:
        c = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def levels_of(n: int) -> int:
    """Levels above the n leaves of a tree."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def build(digests: Sequence[str], levels: int) -> Node:
    """The tree of ``levels`` levels (enough for one root) over ``digests``."""
    row = [Node(d, ()) for d in digests]
    for _ in range(levels):
        runs = [tuple(row[k:k + FAN]) for k in range(0, len(row), FAN)]
        row = [Node(hashed("".join(c.digest for c in run)), run) for run in runs]
    return row[0]


def altered(node: Node, levels: int, place: int, digest: str) -> Node:
    """The version of the tree whose leaf at ``place`` is ``digest``: copies that leaf's ancestors only."""
    if not levels:
        return Node(digest, ())
    k, rest = divmod(place, FAN ** (levels - 1))
    children = node.children[:k] + (altered(node.children[k], levels - 1, rest, digest),) + node.children[k + 1:]
    return Node(hashed("".join(c.digest for c in children)), children)


def way_up(node: Node, levels: int, place: int) -> list[Step]:
    """The steps from the leaf at ``place`` to ``node``, lowest first."""
    steps = []
    for level in range(levels - 1, -1, -1):
        k, place = divmod(place, FAN ** level)
        steps.append(Step(k, "".join(c.digest for j, c in enumerate(node.children) if j != k)))
        node = node.children[k]
    return steps[::-1]


def fold(digest: str, steps: Sequence[Step]) -> str:
    """The root that ``digest`` leads to."""
    for s in steps:
        cut = s.place * DIGEST
        digest = hashed(s.siblings[:cut] + digest + s.siblings[cut:])
    return digest


def _own_steps(parent: pa.Table) -> list[Step]:
    return [Step(s["place"], s["siblings"]) for s in parent.column("path")[0].as_py()]


def _block_root(height: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        n = rows.column("n")[0].as_py()
        root = build(rows.column("digest").to_pylist(), min(height, levels_of(n)))
        return pa.table({"tree": [key[0].as_py()], "idx": pa.array([key[1].as_py()], pa.int64()),
                         "n": pa.array([-(-n // FAN ** height)], pa.int64()), "digest": [root.digest]})
    return run


def _block_ways(height: int):
    def run(key: tuple, rows: pa.Table, parent: pa.Table) -> pa.Table:
        """Every node's way to the root: through its block, then the block's own."""
        rows = rows.sort_by("idx")
        levels = min(height, levels_of(rows.column("n")[0].as_py()))
        tree, above = build(rows.column("digest").to_pylist(), levels), _own_steps(parent)
        paths = [[s._asdict() for s in way_up(tree, levels, k) + above] for k in range(len(rows))]
        return pa.table({
            "tree": rows.column("tree"), "idx": rows.column("idx"),
            "subroot": pa.array([parent.column("subroot")[0].as_py()] * len(rows), pa.string()),
            "root": pa.array([parent.column("root")[0].as_py()] * len(rows), pa.string()),
            "path": pa.array(paths, pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())])))})
    return run


def _block_proofs(height: int):
    def run(key: tuple, rows: pa.Table, parent: pa.Table) -> pa.Table:
        """The proof and the recomputed root of every leaf of a block."""
        rows = rows.sort_by("idx")
        levels = min(height, levels_of(rows.column("n")[0].as_py()))
        leaves = rows.column("digest").to_pylist()
        tree, above = build(leaves, levels), _own_steps(parent)
        rest = "".join(s.siblings for s in above)
        untouched = fold(tree.digest, above)
        proofs, folded = [], []
        for k, other in enumerate(rows.column("other").to_pylist()):
            proofs.append(hashed("".join(s.siblings for s in way_up(tree, levels, k)) + rest))
            folded.append(untouched if other is None else fold(altered(tree, levels, k, other).digest, above))
        subroot, root = (parent.column(c)[0].as_py() for c in ("subroot", "root"))
        return pa.table({"id": rows.column("id"), "leaf": pa.array(leaves), "subroot": pa.array([subroot] * len(rows)),
                         "root": pa.array([root] * len(rows)), "proof_sha256": pa.array(proofs),
                         "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded])})
    return run


def _by_block(nodes: DataFrame, height: int):
    return nodes.withColumn("block", F.expr(f"idx div {FAN ** height}")).groupBy("tree", "block")


def _with_parents(nodes: DataFrame, ways: DataFrame, height: int):
    return _by_block(nodes, height).cogroup(ways.withColumnRenamed("idx", "block").groupBy("tree", "block"))


def _rounds_up(nodes: DataFrame, height: int, label: str) -> list[DataFrame]:
    """``nodes`` and the nodes that are left after each round of blocks, down to one per tree."""
    rounds = [nodes.select("tree", "idx", "n", "digest")]
    size = nodes.agg(F.max("n")).first()[0] or 1
    while size > 1:
        up = _by_block(rounds[-1], height).applyInArrow(_block_root(height), "tree string, idx long, n long, digest string")
        rounds.append(staged(up, label))
        size = -(-size // FAN ** height)
    return rounds


def _ways_down(ways: DataFrame, rounds: Sequence[DataFrame], height: int, label: str) -> DataFrame:
    """The ways of the nodes of the lowest of ``rounds``, from those of the highest."""
    for nodes in reversed(rounds):
        ways = staged(_with_parents(nodes, ways, height).applyInArrow(
            _block_ways(height), f"tree string, idx long, subroot string, root string, path {PATH}"), label)
    return ways


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             id_col: str = "doc_id", source: str = "source", other: Mapping[str, Column] | None = None,
             where: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Leaf, roots, inclusion proof and verification of every row of ``docs``.

    ``other`` gives the values of fields as they are found when the dataset is
    verified, for the rows that ``where`` selects (default: none differ); the
    root recomputed from such a leaf is that of its version of the tree.
    ``block_levels`` is the height of the blocks, 16 ** block_levels rows the
    largest group of a task.
    Returns (id_col, leaf, subroot, root, proof_sha256, folded_root, verified),
    one row per row.  Trees are those of the sources, null first, then by their
    UTF-8 bytes; leaves go by id (null first), then by digest, so rows that
    repeat an id are leaves of their own.  A null field counts as ``-``, an empty
    text as ``0:``.  ``where`` null means not selected.  Other columns play no
    part; an empty table gives an empty table.
    """
    now = {f: F.col(f) for f in fields} | dict(other or {})
    found = F.when(F.coalesce(where, F.lit(False)) if where is not None else F.lit(False),
                   leaf_digest([now[f] for f in fields]))
    leaves = docs.select(F.coalesce(F.concat(F.lit("1"), F.col(source).cast("string")), F.lit("0")).alias("tree"),
                         F.col(id_col).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("digest"),
                         found.alias("other"))
    leaves = staged(numbered(leaves, ["id", "digest"], "leaves"), "leaves")
    rounds = _rounds_up(leaves, block_levels, "nodes")
    subroots = rounds[-1].select("tree", "digest")

    sources = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = staged(numbered(sources, ["source"], "sources"), "sources")
    above = _rounds_up(sources, block_levels, "upper_nodes")
    none = F.array().cast(PATH)
    top = above[-1].select("tree", "idx", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"),
                           none.alias("path"))
    ways = _ways_down(top, above[:-1], block_levels, "upper_ways")
    ways = sources.select("idx", F.col("source").alias("tree"), F.col("digest").alias("subroot")).join(
        ways.select("idx", "root", "path"), "idx").select("tree", F.lit(0).cast("long").alias("idx"), "subroot", "root",
                                                          "path")
    # A tree of one leaf has no round: its leaf is the subroot, and its way is the subroot's.
    ways = _ways_down(ways, rounds[1:-1], block_levels, "ways")
    id_type = docs.schema[id_col].dataType.simpleString()
    proofs = _with_parents(leaves, ways, block_levels).applyInArrow(
        _block_proofs(block_levels), f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, "
                                     "folded_root string, verified boolean")
    return proofs.withColumnRenamed("id", id_col)
