"""Temp views for the SQL path: the shared stages under stable names.

    register_views(spark, obs)
    spark.sql("SELECT state, max(case_inc) FROM increments GROUP BY state")

Views expand inline in each query (nothing is materialised); pass a
materialised ``group_day`` (see ``plans.stage.stage_table``) when several
queries run on the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cumulus.operators.stages import group_day, increments, with_increments


def register_views(spark: SparkSession, obs: DataFrame | None = None, sd: DataFrame | None = None,
                   prefix: str = "") -> list[str]:
    if obs is not None:
        obs.createOrReplaceTempView(f"{prefix}obs")
    if sd is None:
        if obs is None:
            raise ValueError("give obs or sd")
        sd = group_day(obs)
    sd.createOrReplaceTempView(f"{prefix}group_day")
    with_increments(sd).createOrReplaceTempView(f"{prefix}increments_all")
    increments(sd).createOrReplaceTempView(f"{prefix}increments")
    return [f"{prefix}{v}" for v in (["obs"] if obs is not None else []) + ["group_day", "increments_all", "increments"]]


def register_marts(spark: SparkSession, sd: DataFrame, coords: DataFrame | None = None,
                   prefix: str = "", include_clusters: bool = False) -> list[str]:
    """Register every mart over the group-day table ``sd`` as a temp view (lazy).

    SQL written against result views keeps working, e.g.
    ``SELECT date, state, total_cases FROM group_snapshot ORDER BY total_cases DESC LIMIT 10``.
    k-means fits eagerly, so ``risk_clusters`` is only registered on request.
    """
    from cumulus.plans.pipeline import mart_builders
    names = []
    for name, build in mart_builders(coords).items():
        if name == "risk_clusters" and not include_clusters:
            continue
        build(sd).createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names
