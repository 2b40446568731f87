import math
import random

import numpy as np
import pytest

from cumulus.llm import embedding_links


def brute(rows, threshold):
    """(id, links, component) of every row, by plain cosines."""
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    ok = [i is not None and label is not None and usable(v) for i, v, label in rows]
    linked = [[False] * n for _ in rows]
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                linked[a][b] = x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold
    ids = {r[0] for r in rows if r[0] is not None}
    root = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a in range(n):
            for b in range(n):
                if linked[a][b]:
                    low = min(root[rows[a][0]], root[rows[b][0]])
                    for i in (rows[a][0], rows[b][0]):
                        if root[i] != low:
                            root[i], moved = low, True
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted(((i, sum(linked[k]), root.get(i)) for k, (i, _, _) in enumerate(rows)), key=key), key


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "x") for i, v, label in rows],
                                 "vec_id long, embedding array<float>, label int, n_links int, rep string")


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(4)
    out = []
    for label in (1, 2, None):
        for centre in draw.normal(size=(12, 10)):
            for _ in range(int(draw.integers(1, 8))):
                out.append((len(out) * 2, (centre + draw.normal(size=10) * 0.12).astype(np.float32).tolist(), label))
    same = out[0][1]
    out += [(1000 + k, same, 1) for k in range(6)] + [(1100, [2 * x for x in same], 1), (1101, same, 2)]
    out += [(1200, None, 1), (1201, [], 1), (1202, [0.0] * 10, 1), (1203, [math.nan] + same[1:], 1),
            (1204, [None] + same[1:], 1), (1205, [math.inf] + same[1:], 1), (1206, same[:5], 1), (1207, same[:5], 1)]
    out += [(None, same, 1), (1000, same, 1), (1001, out[9][1], 1)]
    return out


@pytest.mark.parametrize("tile", [2048, 8])
def test_all_pairs(spark, rows, tile, monkeypatch):
    monkeypatch.setattr(embedding_links, "TILE", tile)
    want, key = brute(rows, 0.93)
    out = embedding_links.links(frame(spark, rows), 0.93).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=key) == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out)


def test_empty_table(spark, rows):
    out = embedding_links.links(frame(spark, rows).limit(0))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == 0


def test_early_stops_lose_nothing():
    draw = np.random.default_rng(9)
    x = draw.normal(size=(300, 64)) * np.linspace(3, 0.1, 64)
    x[150:] = x[:150] + draw.normal(size=(150, 64)) * 0.15
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    r, c = embedding_links.links_between(x, x, 0.93)
    assert set(zip(r.tolist(), c.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.93))))


def test_local_components():
    draw = random.Random(2)
    for _ in range(50):
        pairs = [(draw.randrange(30), draw.randrange(30)) for _ in range(20)]
        root = embedding_links._roots(30, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
        want = list(range(30))
        for _ in range(30):
            for a, b in pairs:
                want[a] = want[b] = min(want[a], want[b])
        assert root.tolist() == want
