"""Risk tiers over (latest cases, latest deaths, peak increment) by k-means.

``risk_clusters`` divides each feature by its sample deviation (no centring) and
clusters with ``operators.kmeans``: exact whole-number arithmetic and
deterministic seeds, so labels do not depend on layout or machine.  Cluster ids go by
ascending centre size, so id 0 is the smallest-magnitude tier.  k is lowered to
the number of different points.

``risk_clusters_mllib`` is the original job's way (VectorAssembler ->
StandardScaler -> MLlib KMeans over several seeds, lowest cost kept): the same
columns, labels as good as its random starts.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulus.constants import KMEANS_K, KMEANS_SEED, TIER_NAMES
from cumulus.operators.kmeans import best_centres, centres_literal, deviations, nearest, on_grid, whole_value
from cumulus.plans.stage import stage_table

FEATURES = ("total_cases", "total_deaths", "max_daily_inc")


def scaled_features(features: DataFrame, inputs: Sequence[str] = FEATURES, log_scale: bool = False) -> DataFrame:
    """M1, M2: (state, *inputs, features): the inputs as a vector, each over its sample standard deviation."""
    fcols = [f"_f{i}" for i in range(len(inputs))]
    rows = features.select("state", *inputs).repartition("state").sortWithinPartitions("state")
    rows = rows.select("*", *[(F.log1p(c) if log_scale else F.col(c)).cast("double").alias(f)
                              for c, f in zip(inputs, fcols)])
    assembled = VectorAssembler(inputCols=fcols, outputCol="raw_features").transform(rows)
    model = StandardScaler(inputCol="raw_features", outputCol="features", withStd=True, withMean=False).fit(assembled)
    return model.transform(assembled).select("state", *inputs, "features")


def risk_clusters(features: DataFrame, k: int = KMEANS_K, inputs: Sequence[str] = FEATURES,
                  log_scale: bool = False) -> DataFrame:
    """(state, *inputs, prediction).  Rows with a null feature get a null prediction and no part in the centres."""
    kinds = dict(features.dtypes)
    whole = [f"_v{i}" for i in range(len(inputs))]
    rows = features.select("state", *inputs, *[whole_value(c, kinds[c], log_scale).alias(v) for c, v in zip(inputs, whole)])
    # Written once: every seed and round scans this small table, not the plan of the features.
    rows = stage_table(features.sparkSession, rows, "features")
    known = rows.dropna(subset=whole)
    z = F.array(*[on_grid(F.col(v), d) for v, d in zip(whole, deviations(known, whole))])
    centres = best_centres(known.select("state", z.alias("z")), "state", len(inputs), k)
    placed = rows.select("state", *inputs, z.alias("z"))
    if not centres:
        return placed.select("state", *inputs, F.lit(None).cast("int").alias("prediction"))
    label = f"CASE WHEN NOT exists(z, v -> v IS NULL) THEN {nearest(centres_literal(centres))}.k END"
    return placed.select("state", *inputs, F.expr(label).cast("int").alias("prediction"))


def risk_clusters_mllib(features: DataFrame, k: int = KMEANS_K,
                        seeds: Sequence[int] = (KMEANS_SEED, KMEANS_SEED + 1, KMEANS_SEED + 2),
                        inputs: Sequence[str] = FEATURES, log_scale: bool = False) -> DataFrame:
    scaled = scaled_features(features, inputs, log_scale)
    held = scaled.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        k_eff = held.select("features").distinct().limit(k).count()
        if k_eff < 2:
            return scaled.select("state", *inputs, F.lit(0).alias("prediction"))
        # The seeds' fits are independent small jobs: submit them together.
        with ThreadPoolExecutor(max_workers=len(seeds)) as pool:
            models = list(pool.map(lambda s: KMeans(k=k_eff, seed=s, featuresCol="features").fit(held), seeds))
        best, cost = None, math.inf
        for model in models:  # first lowest cost wins, in seed order
            c = model.summary.trainingCost
            if c < cost - 1e-12:
                best, cost = model, c
    finally:
        held.unpersist()
    centres = [list(map(float, c)) for c in best.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: (math.fsum(v * v for v in centres[i]), centres[i]))
    relabel = F.create_map(*[x for new, old in enumerate(order) for x in (F.lit(old), F.lit(new))])
    out = best.transform(scaled)
    return out.select("state", *inputs, relabel[F.col("prediction")].cast("int").alias("prediction"))


def cluster_tiers(clusters: DataFrame, names: Sequence[str] = TIER_NAMES) -> DataFrame:
    """Canonical cluster id -> tier name (ids are ordered by centre size)."""
    tier = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("prediction") + 1)
    return clusters.withColumn("tier", tier)
