import random

import pytest
from pyspark.sql import functions as F

from cumulus.operators import kmeans as K
from cumulus.operators import marts as M
from cumulus.operators.clustering import cluster_tiers, risk_clusters, risk_clusters_mllib
from cumulus.plans import registry as R

SCHEMA = "state string, total_cases bigint, total_deaths bigint, max_daily_inc bigint"
FEATURES = ("total_cases", "total_deaths", "max_daily_inc")


def rows(seed, n):
    draw = random.Random(seed)
    return [(f"g{k:03d}", *[int(draw.lognormvariate(mu, 1.2)) for mu in (9, 5, 6)]) for k in range(n)]


def cost(table, labels):
    """Sum of squared distances to the cluster means, in deviations."""
    n = len(table)
    points = {}
    for i in range(1, 4):
        column = [r[i] for r in table]
        mean = sum(column) / n
        deviation = (sum((v - mean) ** 2 for v in column) / (n - 1)) ** 0.5
        for r in table:
            points.setdefault(r[0], []).append(r[i] / deviation)
    total = 0.0
    for label in set(labels.values()):
        own = [points[s] for s in points if labels[s] == label]
        centre = [sum(c) / len(own) for c in zip(*own)]
        total += sum((a - b) ** 2 for p in own for a, b in zip(p, centre))
    return total


@pytest.mark.parametrize("seed", [1, 2])
def test_same_labels_under_three_layouts(spark, seed):
    table = spark.createDataFrame(rows(seed, 200), SCHEMA)
    found = [sorted((r.state, r.prediction) for r in risk_clusters(df).collect())
             for df in (table.coalesce(1), table.repartition(7), table.orderBy(F.rand(seed)).repartition(13))]
    assert found[0] == found[1] == found[2] and {p for _, p in found[0]} == {0, 1, 2, 3}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("fixture", ["B2", "B3"])
def test_cost_is_not_above_the_best_of_mllib(spark, sf, fixture):
    features = M.risk_features(R.staged_group_day(spark, f"/root/testdata/{sf}", fixture))
    table = [tuple(r) for r in features.collect()]
    if len(table) < 8:
        pytest.skip("too few groups report on the last day")
    own, other = ({r.state: r.prediction for r in f(features).collect()} for f in (risk_clusters, risk_clusters_mllib))
    assert cost(table, own) <= cost(table, other) + 1e-9


def test_fewer_points_than_clusters_nulls_and_no_rows(spark):
    def labels(table):
        out = risk_clusters(spark.createDataFrame(table, SCHEMA))
        assert out.columns == ["state", *FEATURES, "prediction"]
        return {r.state: r.prediction for r in out.collect()}

    assert labels([]) == {}
    assert labels([("a", 1, 2, 3)]) == {"a": 0}
    assert labels([("a", 5, 5, 5), ("b", 5, 5, 5), ("c", 5, 5, 5)]) == {"a": 0, "b": 0, "c": 0}
    assert labels([("a", 1, 1, 1), ("b", 900, 1, 1), ("c", 1, 1, 1)]) == {"a": 0, "b": 1, "c": 0}
    assert labels([("a", 1, 1, 1), ("b", 900, 1, 1), ("c", None, 1, 1)]) == {"a": 0, "b": 1, "c": None}


def test_large_and_negative_counts_are_exact(spark):
    table = [(f"g{k}", (k % 4) * 10 ** 15 + k, -(k % 4) * 10 ** 14, 7) for k in range(40)]
    got = {r.state: r.prediction for r in risk_clusters(spark.createDataFrame(table, SCHEMA)).collect()}
    assert all(got[f"g{k}"] == k % 4 for k in range(40))


def test_log_scale_and_other_inputs(spark):
    table = [(f"g{k}", 10 ** (k % 3 + 1), 1, 1) for k in range(12)]
    got = {r.state: r.prediction for r in risk_clusters(spark.createDataFrame(table, SCHEMA), k=3, inputs=["total_cases"],
                                                        log_scale=True).collect()}
    assert all(got[f"g{k}"] == k % 3 for k in range(12))


def test_traversal_takes_the_farthest_point_and_breaks_ties_by_name(spark):
    points = spark.createDataFrame([("d", [0]), ("a", [10]), ("b", [-10]), ("c", [1])], "state string, z array<bigint>")
    assert K.traversal(points, "state", 1, 9) == [(0,), (10,), (-10,), (1,)]


def test_tiers_are_named_by_size(spark):
    table = [(f"g{k}", 100 * 10 ** k, 1, 1) for k in range(4)]
    got = {r.state: r.tier for r in cluster_tiers(risk_clusters(spark.createDataFrame(table, SCHEMA))).collect()}
    assert got["g3"] == "very high" and got["g0"] == "low"
