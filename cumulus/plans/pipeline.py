"""The whole batch as one Spark application.

The original ran six separate jobs that each re-read and re-aggregated the
input.  Here the group-day table -- the only stage that reads the large
observation table -- is computed once and written as a Parquet table under the
cluster's shared checkpoint folder (``spark.checkpoint.dir``).  Reading it back
cuts the lineage: a lost executor re-reads that table instead of re-scanning
the input.  Every mart is then computed from it and written to ``out_dir``.

    python -m cumulus.plans.pipeline --tsv hdfs:///data/us-counties.txt --out hdfs:///out
    python -m cumulus.plans.pipeline --sf-dir /root/testdata/sf0.1 --fixture B3 --out /tmp/out
"""

from __future__ import annotations

import argparse
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cumulus.operators import marts as M
from cumulus.operators.clustering import risk_clusters
from cumulus.plans import batch
from cumulus.plans.stage import stage_group_days, stage_table
from cumulus.sources.dimensions import nation_coords, reference_coords
from cumulus.sources.fixtures import FIXTURES
from cumulus.sources.observations import read_obs
from cumulus.sources.results import write_result

# The original outputs 1-8 were single files, in this order (column, descending).
FILE_ORDER = {
    "daily_totals": [("date", False)], "daily_increase": [("date", False)],
    "group_snapshot": [("total_cases", True), ("state", False)],
    "top10_cases": [("total_cases", True), ("state", False)],
    "top10_deaths": [("total_deaths", True), ("state", False)],
    "bottom10_cases": [("total_cases", False), ("state", False)],
    "bottom10_deaths": [("total_deaths", False), ("state", False)],
    "overall_and_group_rate": [("sort_sign", False), ("death_rate", True), ("state", False)],
}
# Those of a bounded size (a row per calendar day, or ten rows) are single files by default.
SINGLE_FILE = ("daily_totals", "daily_increase", "top10_cases", "top10_deaths", "bottom10_cases", "bottom10_deaths")


def file_order(name: str) -> list[Column] | None:
    keys = FILE_ORDER.get(name)
    return keys and [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in keys]


def mart_builders(coords: DataFrame | None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    b: dict[str, Callable[[DataFrame], DataFrame]] = {
        name: getattr(M, name) for name in [
            "daily_totals", "daily_increase", "group_snapshot", "top10_cases", "top10_deaths",
            "bottom10_cases", "bottom10_deaths", "overall_and_group_rate", "rolling_mean_7",
            "peak_increment", "growth_rate", "monthly_top10", "weekday_profile",
            "case_fatality_series", "doubling_time", "pareto_share", "lagged_correlation",
            "zscore_anomaly", "day0_alignment", "reproduction_ratio"]
    }
    if coords is not None:
        b["weighted_centroid"] = lambda sd: M.weighted_centroid(sd, coords)
    b["risk_clusters"] = lambda sd: risk_clusters(M.risk_features(sd))
    return b


def materialise_group_day(spark: SparkSession, obs: DataFrame) -> DataFrame:
    """group_day(obs) with its increments, written once under the shared checkpoint folder,
    bucketed by group, and read back."""
    return stage_group_days(spark, obs)


def run_all(spark: SparkSession, obs: DataFrame, out_dir: str, coords: DataFrame | None = None,
            fmt: str = "json", names: Iterable[str] | None = None, parallelism: int = 8,
            single_file: Iterable[str] = SINGLE_FILE) -> dict[str, str]:
    """Materialise the group-day stage, then write every mart from it (nine of them from one shared scan,
    see ``plans.batch``).

    The marts are independent small jobs over the same stage, so up to
    ``parallelism`` of them are submitted at once from driver threads and the
    scheduler overlaps their tasks.
    """
    sd = materialise_group_day(spark, obs)
    builders = mart_builders(coords)
    todo, single = list(names or builders), set(single_file)
    shared = [n for n in todo if n in batch.NAMES]
    if len(shared) > 1:
        # One scan of the stage feeds all of these; each is then read off the small batch table.
        made = stage_table(spark, batch.snapshot_batch(sd), "batch")
        builders |= {n: (lambda _, n=n: batch.result_of(made, n)) for n in shared}

    def write(name: str) -> tuple[str, str]:
        path = f"{out_dir.rstrip('/')}/{name}"
        write_result(builders[name](sd), path, fmt=fmt, single_file=name in single, sort_by=file_order(name))
        return name, path

    if parallelism <= 1:
        return dict(write(n) for n in todo)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        done = dict(pool.map(write, todo))
    return {n: done[n] for n in todo}


def run_fixture(spark: SparkSession, sf_dir: str, out_dir: str, fixture: str = "B3", **kw) -> dict[str, str]:
    coords = nation_coords(spark, sf_dir)
    return run_all(spark, FIXTURES[fixture](spark, sf_dir), out_dir, coords=coords, **kw)


def run_tsv(spark: SparkSession, path: str, out_dir: str, mode: str = "FAILFAST", **kw) -> dict[str, str]:
    coords = reference_coords(spark)
    return run_all(spark, read_obs(spark, path, mode=mode), out_dir, coords=coords, **kw)


def main(argv=None) -> None:
    from cumulus.session import build_session
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--tsv")
    src.add_argument("--sf-dir")
    ap.add_argument("--fixture", default="B3")
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="json")
    ap.add_argument("--names", help="comma-separated marts to write (default: all)")
    ap.add_argument("--parallelism", type=int, default=8, help="marts submitted at once")
    a = ap.parse_args(argv)
    spark = build_session()
    kw = {"fmt": a.format, "parallelism": a.parallelism,
          "names": a.names.split(",") if a.names else None}
    if a.tsv:
        written = run_tsv(spark, a.tsv, a.out, **kw)
    else:
        written = run_fixture(spark, a.sf_dir, a.out, a.fixture, **kw)
    for name, path in written.items():
        print(name, path)


if __name__ == "__main__":
    main()
