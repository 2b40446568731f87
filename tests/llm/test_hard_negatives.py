import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulus.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, id string, i int, windows int"


def brute(rows, positives=5, negatives=5):
    """Every anchor's result, by plain integer products of all pairs."""
    taking = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taking.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for i, v, label in taking:
        if i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), k, other == label) for k, w, other in taking if len(w) == len(v)]
        best = sorted(((s, k) for s, k, same in scored if same and k != i), key=lambda x: (-x[0], x[1]))
        for p, k in best[:positives]:
            hard = sorted(((s, j) for s, j, same in scored if not same and 80 * p <= 100 * s <= 100 * p),
                          key=lambda x: (-x[0], x[1]))
            out += [(i, k, rank, j, p, s) for rank, (s, j) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    out = H.mine(frame, F.col("vec_id") % 100 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(12)
    centres = draw.normal(size=(6, 12))
    out = [(k * 20, (centres[k % 6] + draw.normal(size=12) * 0.4).tolist(), int(draw.integers(0, 4))) for k in range(240)]
    same = out[0][1]
    out += [(5000 + k, same, k % 3) for k in range(8)] + [(5100, [0.0] * 12, 1), (5200, [], 1), (5201, [], 2)]
    out += [(5300, same[:5], 1), (5301, same[:5], 1), (5302, same[:5], 2), (5303, [2 * x for x in same[:5]], 1)]
    out += [(5400, None, 1), (5500, same, None), (None, same, 1), (5600, [None] + same[1:], 1),
            (5700, [math.nan] + same[1:], 1), (5800, [math.inf] + same[1:], 1)]
    out += [(0, same, out[0][2]), (100, out[9][1], 2)]
    return out


@pytest.mark.parametrize("stripe", [(8192, 1024), (16, 4)])
def test_all_pairs(spark, rows, stripe, monkeypatch):
    monkeypatch.setattr(H, "ROWS", stripe[0])
    monkeypatch.setattr(H, "ANCHORS", stripe[1])
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(100 * k, [3e5 + k / 7, 2e5 - k, 12345.678 * k], k % 2) for k in range(12)]
    assert brute(rows) and any(r[4] > 2 ** 53 for r in brute(rows))
    assert mined(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    few = [(100, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.9, 0.0], 2), (4, [0.1, 0.0], 2)]
    assert mined(spark, few) == brute(few) == [(100, 2, 1, 3, 65536, 58880)]


def test_bounds_hold_every_score():
    draw = np.random.default_rng(3)
    x = np.floor(draw.normal(size=(150, 24)) * 100)
    x[:40] = np.floor(x[:40] * 0.01 + 300)
    known = H.directions(list(x), H.DIRECTIONS)[24]
    norms = np.sqrt((x * x).sum(axis=1))
    angles = np.arccos(np.clip(x @ known.T / np.maximum(norms, 1)[:, None], -1, 1))
    low, high = H.score_bounds((norms, norms), (angles, angles))
    scores = x @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    # Not vacuous: rows of the tight cluster are bounded well below the product of their norms.
    assert (high[:40, 40:] < 0.9 * norms[:40, None] * norms[None, 40:]).mean() > 0.5


def test_rows_outside_a_window_are_not_scored(monkeypatch):
    seen = []
    plain = H._scores
    monkeypatch.setattr(H, "_scores", lambda x, y, r, c: seen.append(len(r)) or plain(x, y, r, c))
    angle = np.linspace(0, math.pi, 400)
    whole = np.floor(np.stack([np.cos(angle), np.sin(angle)], axis=1) * 1000)
    norm = np.sqrt((whole ** 2).sum(axis=1))
    angles = np.arccos(np.clip(whole @ np.array([[1.0, 0.0], [0.0, 1.0]]) / norm[:, None], -1, 1))
    rows = {"id": np.arange(400), "label": np.ones(400, int), "whole": whole, "norm": norm, "angles": angles}
    anchor = {k: v[:1] for k, v in rows.items()} | {"key": np.array([0]), "windows": [[(800_000, 900_000)]]}
    anchor["label"] = np.zeros(1, int)
    found = H.windows_best(anchor, rows, False, 400)
    assert len(found) == sum(800_000 <= s <= 900_000 for s in (whole @ whole[0])) and 0 < sum(seen) < 60
