"""Operator 2: near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles.  Equal sets form one class, and only
each class's smallest id goes on.  In every tree a document walks down from the
root: at a node it follows the branch named by one minwise token of its set, and
by a second one with the chance that makes 1 / similarity branches on average, so
a pair of the wanted similarity keeps about one common branch at any depth.  Which
minwise tokens a node asks for depends on the node alone.  The walk to the first
useful depth needs no data of others; then nodes are counted.  Documents of small
nodes are compared exhaustively (by 128-bit sketches, which lose a pair at the
threshold with a chance of about 1e-6); in large nodes everyone is compared with
the node's smallest id, and nodes that still hold several components branch on.
Of nodes that hold the same documents only one is compared.  Branching ends at
the last depth, or when the largest node is a few blocks: the documents of nodes
that are large by then are put into groups of nodes that overlap, and each group is
cut into a few blocks; blocks that share a node are compared once, in a task that
holds their sets and returns only links.
Every pair that passes is confirmed on the full sets.  Pairs whose documents are
connected already need no confirmation: the result is the components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cumulus.llm.staging import connected_components, dropped, staged

COORDINATES = 128        # minwise tokens of a signature; each also gives one bit of the sketch
DEPTHS = (3, 5, 8)       # branchings after which nodes are counted; those large to the last are compared in blocks
SMALL_NODE = 32          # documents that a node may hold to be compared exhaustively
BLOCK = 512              # documents of a block of large nodes, at least, where its group has several
BLOCKS = 8               # blocks of a group, at most, while they fit; also those of the largest node for branching to end early
BLOCK_BYTES = 8 << 20    # bytes of a block's sets, about; a group of more than BLOCKS times that has more blocks
FILTER_BITS = 23         # two to this power: bits of the filter of ids whose texts are needed
RECALL = 1 - 1e-7        # chance to find a pair exactly at the threshold
PART_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_BASE = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of every text's word shingles."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    room = PART_BYTES
    for text in texts:
        if part and len(text) > room:
            out += _sets_of_part(part, words)
            part, room = [], PART_BYTES
        part.append(text)
        room -= len(text)
    return out + (_sets_of_part(part, words) if part else [])


def _sets_of_part(texts: list[bytes], words: int) -> list[np.ndarray]:
    raw = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    space = _SPACES[raw]
    start = ~space
    start[1:] &= space[:-1]
    starts = np.flatnonzero(start)
    sizes = np.array([len(t) + 1 for t in texts])
    edges = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])).tolist()
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    solid = np.flatnonzero(~space)
    place = solid - starts[np.cumsum(start[solid]) - 1]
    powers = np.ones(int(place.max()) + 1, dtype=np.uint64)
    powers[1:] = np.uint64(_WORD_BASE)
    powers = np.cumprod(powers)
    hashes = _mix(np.add.reduceat(_BYTE[raw[solid]] * powers[place], np.flatnonzero(start[solid])))
    return [_shingles(hashes[a:b], words) for a, b in zip(edges, edges[1:])]


def _shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    n = min(words, len(hashes))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        total = _mix(total * np.uint64(_WORD_BASE) + hashes[j:len(hashes) - n + 1 + j])
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set: per coordinate the upper half of the smallest permuted hash."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 1024):
        best = np.minimum(best, (hashes[None, k:k + 1024] * _MULTIPLY[:, None]).min(axis=1))
    return (_mix(best) >> np.uint64(32)).astype("<u4")


def sketch(signatures: np.ndarray) -> np.ndarray:
    """One bit per coordinate of each signature row, as two signed 64-bit integers."""
    bits = np.packbits((signatures & 1).astype(np.uint8), axis=1)
    return bits.view("<i8").reshape(len(signatures), -1)


def paths(signatures: np.ndarray, trees: int, depth: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and node hashes that the rows reach at ``depth`` of all trees."""
    n = len(signatures)
    node = np.repeat(_mix(np.arange(1, trees + 1, dtype=np.uint64)), n)
    row = np.tile(np.arange(n), trees)
    second = np.uint64(int((1 / similarity - 1) * 2**32))
    for level in range(depth):
        draw = _mix(node + np.uint64((level + 1) * _WORD_BASE % 2**64))
        one = (draw >> np.uint64(32)) % np.uint64(COORDINATES)
        again = _mix(draw)
        more = np.flatnonzero((again & np.uint64(0xFFFFFFFF)) < second)
        other = (one[more] + np.uint64(1) + (again[more] >> np.uint64(32)) % np.uint64(COORDINATES - 1)) % np.uint64(
            COORDINATES)
        row, node, at = (np.concatenate([row, row[more]]), np.concatenate([draw, draw[more]]),
                         np.concatenate([one, other]))
        token = signatures[row, at.astype(np.int64)].astype(np.uint64)
        node = _mix(node ^ _mix(token | at << np.uint64(32)))
    return row, node.astype(np.int64)


def miss_chance(depth: int, similarity: float) -> float:
    """Chance that a pair of the given similarity shares no branch of one tree at ``depth``."""
    p = 1 / similarity - 1
    q = 0.0
    for _ in range(depth):
        x = 1 - similarity + similarity * q
        q = (1 - p) * x + p * x * x
    return q


def trees_for(recall: float, depth: int, similarity: float) -> int:
    """Independent trees needed for the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(miss_chance(depth, similarity)))


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, digest, sig) of every row; digest and sig are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(s) for s in sets], type=pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                         type=pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], type=pa.binary()),
            ], names=["id", "n", "digest", "sig"])

    return docs.mapInArrow(run, "id long, n long, digest binary, sig binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, members): packed sorted hashes of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], type=pa.binary())],
                                             names=["id", "members"])

    return docs.mapInArrow(run, "id long, members binary")


def _sketches(reps: DataFrame) -> DataFrame:
    """(id, n, s0, s1) of class representatives."""
    longs = [f"s{i}" for i in range(COORDINATES // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u4").reshape(-1, COORDINATES)
            bits = sketch(rows) if len(rows) else np.zeros((0, len(longs)), dtype="<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)] + [
                pa.array(bits[:, i]) for i in range(len(longs))], names=["id", "n", *longs])

    return reps.select("id", "n", "sig").mapInArrow(run, "id long, n long, " + ", ".join(f"{c} long" for c in longs))


def _nodes(active: DataFrame, trees: int, depth: int, similarity: float) -> DataFrame:
    """(node, id, component) of all branches at ``depth``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, components = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            rows = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u4").reshape(-1, COORDINATES)
            for k in range(0, len(ids), 1024):
                row, node = paths(rows[k:k + 1024], trees, depth, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(ids[k:k + 1024][row]),
                                                  pa.array(components[k:k + 1024][row])], names=["node", "id", "component"])

    return active.select("id", "component", "sig").mapInArrow(run, "node long, id long, component long")


def _to_compare(nodes: DataFrame) -> DataFrame:
    """(node, c, lo) of the nodes in which something is left to find: c documents, the smallest of them.

    Nodes within one component have nothing left; of nodes that hold the same
    documents (by their number and two hashes) the smallest is enough.
    """
    sizes = nodes.groupBy("node").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "component")).alias("lo"),
        F.min("component").alias("x"), F.max("component").alias("y"),
        F.bit_xor(F.xxhash64("id")).alias("h"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("g")).where("x < y")
    return sizes.groupBy("c", "h", "g").agg(F.min(F.struct("node", "lo")).alias("m")).select("m.node", "c", "m.lo")


def _needed_texts(base: DataFrame, ids: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The rows of ``base`` with one of the ids, and the broadcast that they need.

    A bit filter of a fixed size (one bit per residue of the id) goes to every task
    first, so that few texts are shuffled that the join then drops.  The join is never
    a broadcast: the sets are made in a later stage, as a task that runs two Python functions
    has two workers, all of which are kept for later queries and take turns in their tasks.
    """
    bits = 1 << FILTER_BITS
    place = F.expr(f"cast((id ^ shiftright(id, {FILTER_BITS})) & {bits - 1} AS int)")
    words = ids.select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, p % 64))").alias("b")).collect()
    mask = np.zeros(bits // 64, dtype=np.int64)
    for r in words:
        mask[r["w"]] = r["b"]
    shared = base.sparkSession.sparkContext.broadcast(mask.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(held[(at ^ (at >> FILTER_BITS)) & (bits - 1)]))

    return base.where("id IS NOT NULL").mapInArrow(run, base.schema).join(ids.hint("merge"), "id", "left_semi"), shared


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar: 100 * common >= percent * united."""
    left = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(good, type=pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _in_small_nodes(members: DataFrame, similarity: float) -> DataFrame:
    """All pairs of a small node that may be similar and are not connected yet."""
    held = members.groupBy("node").agg(F.sort_array(F.collect_list(
        F.struct("id", "n", "component", *[f"s{i}" for i in range(COORDINATES // 64)]))).alias("m"))
    fits = _alike("x", "y", similarity)
    pairs = F.expr("flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), "
                   f"y -> y.id > x.id AND x.component != y.component AND {fits}), y -> struct(x.id AS a, y.id AS b))))")
    return held.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _most_apart(similarity: float) -> int:
    """Sketch bits that may differ at the threshold: five standard deviations over the mean."""
    differ = (1 - similarity) / 2 * COORDINATES
    return int(differ + 5 * math.sqrt(differ * (1 + similarity) / 2))


def _alike(x: str, y: str, similarity: float) -> str:
    """SQL: sketches x and y may be of similar sets, by their bits and sizes."""
    bits = " + ".join(f"bit_count({x}.s{i} ^ {y}.s{i})" for i in range(COORDINATES // 64))
    percent = round(100 * similarity)
    return f"{bits} <= {_most_apart(similarity)} AND 100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"


def _blocks(large: DataFrame) -> DataFrame:
    """(id, block) of the documents of nodes that are large to the last.

    The largest nodes of the trees hold much the same documents.  So a document's
    group is not its own largest node, which differs among neighbours, but the largest
    one that any document beside it has.  A group has a few blocks however many
    documents it holds, and more only where their sets would not fit a task: a
    document meets few blocks, so the rows that are compared grow with the documents.
    """
    nodes = large.select("node", "id", "n", F.struct("c", "node").alias("own"))
    own = nodes.groupBy("id").agg(F.max("own").alias("main"))
    beside = nodes.select("node", "id").join(own, "id").groupBy("node").agg(F.max("main").alias("main"))
    docs = nodes.select("node", "id", "n").join(beside, "node").groupBy("id").agg(
        F.max("main").alias("main"), F.max("n").alias("n")).select("id", "n", F.col("main.node").alias("group"))
    whole = F.least(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(BLOCKS))
    parts = docs.groupBy("group").agg(F.greatest(whole, F.ceil(8 * F.sum("n") / BLOCK_BYTES)).alias("parts"))
    return docs.join(parts, "group").select("id", F.xxhash64("group", F.pmod(F.xxhash64("id"), "parts")).alias("block"))


def _block_pairs(large: DataFrame, blocks: DataFrame) -> DataFrame:
    """(i, j), the pairs of blocks to compare: once if any node holds documents of both, however many trees bring them together."""
    of_node = large.select("node", "id").join(blocks, "id").groupBy("node").agg(F.sort_array(F.collect_set("block")).alias("m"))
    pairs = of_node.select(F.explode("m").alias("i"), "m").select("i", F.explode(F.filter("m", lambda j: j >= F.col("i"))).alias("j"))
    return pairs.distinct()


def _spread(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (block, ...) beside each pair (i, j) of blocks that has theirs."""
    left = pairs.select("i", "j", F.col("i").alias("block"))
    right = pairs.where("i < j").select("i", "j", F.col("j").alias("block"))
    return left.unionByName(right).join(docs, "block")


def _links_in_blocks(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect all similar documents of each pair of blocks, confirmed on the full sets in its task.

    ``docs``: (id, block, component, n, s0, s1, members).  Pairs that a component
    or the links so far connect are left out, so a task returns fewer links than it holds documents.
    """
    most, percent = _most_apart(similarity), round(100 * similarity)
    bits = [f"s{k}" for k in range(COORDINATES // 64)]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        x, y = frame[frame["block"] == i], frame[frame["block"] == j]
        every = sorted({*x["component"], *y["component"]})
        root = np.arange(len(every))
        # Unsigned, as numpy counts the bits of a number's absolute value.
        sx, sy = (f[bits].to_numpy().astype(np.uint64) for f in (x, y))
        nx, ny, ix, iy = (f[c].to_numpy() for c in ("n", "id") for f in (x, y))
        cx, cy = (np.searchsorted(every, f["component"].to_numpy()) for f in (x, y))
        tx, ty = ([np.frombuffer(m, dtype=np.uint64) for m in f["members"]] for f in (x, y))
        # Tokens are numbered once, so that one look at a mark tells whether a set holds one.
        tokens, codes = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *tx, *ty]), return_inverse=True)
        codes = np.split(codes.astype(np.int32), np.cumsum([len(t) for t in (*tx, *ty)]))
        tx, ty = codes[:len(tx)], codes[len(tx):-1]
        held = np.zeros(len(tokens), dtype=bool)
        found = []
        for k in range(len(x)):
            good = (np.bitwise_count(sx[k] ^ sy).sum(axis=1) <= most) & (root[cx[k]] != root[cy])
            good &= 100 * np.minimum(nx[k], ny) >= percent * np.maximum(nx[k], ny)
            if i == j:
                good[:k + 1] = False
            at = np.flatnonzero(good)
            if not len(at) or not len(tx[k]):
                continue
            sizes = [len(ty[c]) for c in at]
            held[tx[k]] = True
            common = np.add.reduceat(held[np.concatenate([ty[c] for c in at])], np.cumsum([0, *sizes[:-1]]), dtype=np.int64)
            held[tx[k]] = False
            alike = 100 * common >= percent * (len(tx[k]) + np.array(sizes) - common)
            for c in at[alike]:
                p, q = root[cx[k]], root[cy[c]]
                if p != q:
                    root[root == max(p, q)] = min(p, q)
                    found.append((min(ix[k], iy[c]), max(ix[k], iy[c])))
        return pd.DataFrame(found, columns=["a", "b"])

    return _spread(pairs, docs).groupBy("i", "j").applyInPandas(run, "a long, b long")


def components(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id",
               text: str = "text", recall: float = RECALL) -> DataFrame:
    """Near-duplicate components: (id_col, n_shingles, component_id, kept), one row per row of ``docs``.

    Words are runs without white space (space and U+0009 to U+000D), A-Z in lower
    case; a text with fewer words than a shingle has its whole sequence as its one
    shingle.  Null texts and texts without words have no shingle and link with
    nothing.  ``kept`` marks the smallest id of a component.  Rows that repeat an
    id share its component.  A row with a null id is linked with nothing, has a
    null component and is kept.  Other columns, whatever their names, play no part;
    an empty table gives an empty table.
    """
    percent = round(100 * similarity)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    every = staged(_signatures(base, words), "signatures")
    full = every.where("id IS NOT NULL AND n > 0")
    classes = full.groupBy("digest").agg(F.min("id").alias("rep"))
    members = staged(full.join(classes, "digest").select(
        "id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("sig")).alias("sig")), "members")
    reps = members.where("sig IS NOT NULL")
    # An id whose rows hold different sets joins the classes of all of them.
    several = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi")
    links = staged(members.join(several.select("id", "a"), "id").where("a != rep")
                   .select("a", F.col("rep").alias("b")).distinct(), "links")
    sketches = staged(_sketches(reps), "sketches")
    found, labels = [links], None
    active = reps.select("id", F.col("id").alias("component"), "sig")
    done: list[DataFrame] = []
    for depth in DEPTHS:
        nodes = _nodes(active, trees_for(recall, depth, similarity), depth, similarity)
        held = staged(nodes.join(_to_compare(nodes), "node").join(sketches, "id"), "nodes")
        dropped(*done)
        first = sketches.select(*[F.col(c).alias(f"{c}_lo") for c in sketches.columns])
        stars = held.where(f"c > {SMALL_NODE} AND component != lo.component").select(
            "id", F.col("lo.id").alias("lo"), "n", "s0", "s1").distinct().join(first, F.col("lo") == F.col("id_lo"))
        stars = stars.select(F.struct("n", "s0", "s1").alias("x"), F.struct(
            *[F.col(f"{c}_lo").alias(c) for c in ("n", "s0", "s1")]).alias("y"), F.col("lo").alias("a"),
            F.col("id").alias("b")).where(F.expr(_alike("x", "y", similarity))).select("a", "b")
        pairs = _in_small_nodes(held.where(f"c <= {SMALL_NODE}"), similarity).unionByName(stars).distinct()
        found += _link(staged(pairs, "candidates"), base, percent, words)
        labels = _components_of(found)
        large = held.where(f"c > {SMALL_NODE}")
        biggest = held.agg(F.max("c")).first()[0] or 0
        if biggest <= SMALL_NODE:
            break
        if depth == DEPTHS[-1] or biggest <= BLOCKS * BLOCK:
            blocks = staged(_blocks(large), "blocks")
            pairs = staged(_block_pairs(large, blocks), "block_pairs")
            sets = _staged_sets(base, blocks.select("id"), words)
            rows = blocks.join(sketches, "id").join(labels, "id", "left").withColumn(
                "component", F.coalesce("component_id", "id")).drop("component_id").join(sets, "id")
            found.append(staged(_links_in_blocks(rows, pairs, similarity), "links"))
            dropped(sets, blocks, pairs, held)
            labels = _components_of(found)
            break
        # The documents of large nodes branch on, under the labels that they have by now.
        active = reps.join(large.select("id").distinct(), "id", "left_semi").select("id", "sig")
        active = staged(active.join(labels, "id", "left").select(
            "id", F.coalesce("component_id", "id").alias("component"), "sig"), "active")
        done = [held, active]
    return _result(every, members, labels, id_col)


def _staged_sets(base: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, members) of the documents with one of the ids, written; an id whose rows differ gives each of its sets."""
    texts, mask = _needed_texts(base, ids)
    sets = staged(_sets(texts, words), "sets")
    mask.destroy()
    return sets


def _link(pairs: DataFrame, base: DataFrame, percent: int, words: int) -> list[DataFrame]:
    """The links that connect what candidate pairs connect: each document is compared with its
    smallest partner first, and then with those that this has not put beside it."""
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ids = staged(needed, "ids")
    sets = _staged_sets(base, ids, words)
    dropped(ids)
    first = pairs.groupBy("b").agg(F.min("a").alias("m"))
    linked = staged(_confirm(first.select(F.col("m").alias("a"), "b"), sets, percent), "links")
    beside = first.join(linked.select("b", F.col("a").alias("of_b")), "b", "left")
    rest = pairs.join(beside, "b").where("a != m").join(
        linked.select(F.col("b").alias("a"), F.col("a").alias("of_a")), "a", "left")
    rest = rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    more = staged(_confirm(rest, sets, percent), "links")
    dropped(sets, pairs)
    return [linked, more]


def _components_of(found: list[DataFrame]) -> DataFrame:
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _result(every: DataFrame, members: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    linked = members.select("id", "n", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    linked = linked.select("id", "n", F.coalesce("component_id", "rep").alias("component_id"))
    alone = every.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                       F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
