"""Differential tests: random observation tables through Spark and through the DuckDB oracle SQL.

The generator produces what the test tables rarely do: equal values (ties in
peaks, ranks and Pareto peers), downward corrections, zero denominators,
sparse days, groups that never reach the thresholds and groups without
coordinates.
"""

import datetime as dt
import os
import random
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from oracle_check import canon  # noqa: E402

from cumulus.operators.stages import group_day  # noqa: E402
from cumulus.plans import oracle as O  # noqa: E402
from cumulus.plans import registry as R  # noqa: E402
from cumulus.sources.observations import OBS_SCHEMA  # noqa: E402

from conftest import SF_SMALL  # noqa: E402


def random_obs(seed: int, scale: int = 1) -> pd.DataFrame:
    rnd = random.Random(seed)
    start = dt.date(2021, 1, 1)
    rows = []
    for g in range(rnd.randint(3, 9)):
        state = f"NATION_{rnd.choice(range(20))}" if g else "NATION_0"
        for u in range(rnd.randint(1, 3)):
            cases = deaths = 0
            for day in range(45):
                if rnd.random() < 0.15:
                    continue                                   # unit silent that day
                step = rnd.choice([0, 0, 1, 2, 5, 10, 10, 40]) * scale
                if rnd.random() < 0.08:
                    step = -rnd.randint(1, 15) * scale         # downward correction
                cases = max(0, cases + step)
                deaths = max(0, deaths + rnd.choice([0, 0, 1]))
                rows.append((start + dt.timedelta(days=day), f"c{u}", state, cases, deaths))
    df = pd.DataFrame(rows, columns=["date", "county", "state", "cases", "deaths"])
    return df.drop_duplicates(["date", "county", "state"])


@pytest.fixture(scope="module", params=[(11, 1), (12, 1), (13, 1), (14, 25_000_000)])
def pair(request, spark):
    pdf = random_obs(*request.param)
    obs = spark.createDataFrame(pdf, OBS_SCHEMA)
    sd = group_day(obs).cache()
    con = duckdb.connect()
    con.register("obs_df", pdf)
    con.execute("CREATE TABLE obs AS SELECT CAST(date AS DATE) AS date, county, state, "
                "CAST(cases AS BIGINT) AS cases, CAST(deaths AS BIGINT) AS deaths FROM obs_df")
    con.execute(f"CREATE VIEW nation AS SELECT * FROM read_parquet('{SF_SMALL}/nation.parquet')")
    return spark, sd, con


@pytest.mark.parametrize("name", sorted(R.REGISTRY))
def test_spark_equals_oracle_on_random_obs(pair, name):
    spark, sd, con = pair
    _, builder = R.REGISTRY[name]
    df = builder(spark, SF_SMALL, sd)
    cur = con.execute(O.statement_on_obs(name))
    sc, sr = canon(df.columns, [tuple(r) for r in df.collect()])
    dc, dr = canon([d[0] for d in cur.description], cur.fetchall())
    assert sc == dc
    assert sr == dr
