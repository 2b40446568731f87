import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cumulus.llm import merkle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx string, other int, path int"


def h(s):
    return sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(row):
    return [h("".join(row[k:k + 16])) for k in range(0, len(row), 16)]


def tree(leaves):
    """All levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(up(levels[-1]))
    return levels


def siblings(levels, i):
    """[(place, run)] of the node i's way up."""
    out = []
    for row in levels[:-1]:
        out.append((i % 16, row[i - i % 16:i - i % 16 + 16]))
        i //= 16
    return out


def brute(rows):
    """Every row's manifest entry, each root recomputed level by level."""
    leaf = {id(r): h("".join(map(field, r))) for r in rows}
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf[id(r)]))
        trees.append(tree([leaf[id(r)] for r in groups[s]]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            way = siblings(trees[k], i) + siblings(top, k)
            found = leaf[id(r)]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                found = h("".join(map(field, [*r[:4], r[4].translate(str.maketrans(UPPER, UPPER.lower()))])))
            for place, run in way:
                found = h("".join(run[:place] + [found] + run[place + 1:]))
            proof = h("".join("".join(run[:p] + run[p + 1:]) for p, run in way))
            out.append((r[0], leaf[id(r)], trees[k][-1][0], top[-1][0], proof, found, found == top[-1][0]))
    return sorted(out, key=repr)


def audited(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, "t", "i", 3, 4) for r in rows], SCHEMA)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle.manifest(docs, other={"text": F.translate("text", UPPER, UPPER.lower())}, where=touched, **kw)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    out = [(k, "hot", "en", 3 * k, f"Text {k} Ä ß") for k in range(300)]
    out += [(1000 + k, f"s{k}", "de" if k % 3 else None, None, "x" * k) for k in range(30)]
    out += [(2000 + k, None, "en", 1, None if k % 2 else "") for k in range(17)]
    out += [(None, "hot", None, None, None), (None, "hot", "en", 1, "Upper"), (5, "hot", "en", 9, "Other text")]
    out += [(7, "hot", "en", 21, "Text 7 Ä ß")] * 2 + [(3000, "", "en", 2, "Long " * 200_000)]
    return out


@pytest.mark.parametrize("height", [1, 2, 3])
def test_against_every_level_by_hand(spark, rows, height):
    out = audited(spark, rows, block_levels=height)
    assert out == brute(rows)
    assert {r[-1] for r in out} == {True, False}


def test_small_tables(spark):
    one = [(4, "a", "en", 1, "x")]
    leaf = h("1:41:a2:en1:11:x")
    assert audited(spark, one) == [(4, leaf, leaf, leaf, h(""), leaf, True)] == brute(one)
    assert audited(spark, []) == []
    two = one + [(4, "b", None, None, None)]
    assert audited(spark, two) == brute(two)


def test_nothing_altered_is_verified(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs).where("NOT verified OR folded_root != root").isEmpty()


def test_versions_share_untouched_nodes():
    base = merkle.build([h(str(k)) for k in range(4096)], 3)
    version = merkle.altered(base, 3, 1234, h("other"))
    assert version.digest != base.digest
    changed = [k for k, (a, b) in enumerate(zip(base.children, version.children)) if a is not b]
    assert changed == [1234 // 256]
    run = [k for k, (a, b) in enumerate(zip(base.children[4].children, version.children[4].children)) if a is not b]
    assert run == [1234 % 256 // 16]
