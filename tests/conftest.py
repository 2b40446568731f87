import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cumulus.session import build_session
    s = build_session("local[4]", app="cumulus-tests", shuffle_partitions=8)
    # Tests run locally with no cluster setting, so they name their own folder.
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cumulus-test-ckpt-"))
    yield s
    s.stop()


# Hand-made observations: three groups, two units for two of them, ten days with a
# national gap on 2020-03-09.  Both date spellings, a downward correction (New York
# on 03-05), a missing day (Texas on 03-03), zero predecessors (Texas), a group whose
# increments are constant 0 (Nowhere), a tie in the peak increment (New York 03-06
# and 03-07), a tie in latest deaths (Texas and Nowhere), a group without
# coordinates (Nowhere) and groups that never reach 100 (Texas, Nowhere).
HAND_TSV = """\
2020/3/1\tKings\tNew York\t10\t0
2020/3/1\tQueens\tNew York\t0\t0
2020/3/1\tHarris\tTexas\t0\t0
2020/3/1\tAlpha\tNowhere\t0\t0
2020/3/1\tBeta\tNowhere\t0\t0
2020-3-2\tKings\tNew York\t30\t1
2020-3-2\tQueens\tNew York\t20\t0
2020-3-2\tHarris\tTexas\t0\t0
2020-3-2\tAlpha\tNowhere\t0\t0
2020-03-03\tKings\tNew York\t60\t2
2020-03-03\tQueens\tNew York\t40\t1
2020-03-03\tAlpha\tNowhere\t0\t0
2020-03-04\tKings\tNew York\t100\t5
2020-03-04\tQueens\tNew York\t100\t3
2020-03-04\tHarris\tTexas\t5\t0
2020-03-04\tAlpha\tNowhere\t0\t0
2020-03-05\tKings\tNew York\t90\t5
2020-03-05\tQueens\tNew York\t100\t3
2020-03-05\tHarris\tTexas\t10\t0
2020-03-05\tAlpha\tNowhere\t0\t0
2020-03-06\tKings\tNew York\t150\t8
2020-03-06\tQueens\tNew York\t150\t4
2020-03-06\tHarris\tTexas\t20\t0
2020-03-06\tAlpha\tNowhere\t0\t0
2020-03-07\tKings\tNew York\t200\t10
2020-03-07\tQueens\tNew York\t210\t6
2020-03-07\tHarris\tTexas\t20\t0
2020-03-07\tAlpha\tNowhere\t0\t0
2020-03-08\tKings\tNew York\t250\t12
2020-03-08\tQueens\tNew York\t250\t8
2020-03-08\tHarris\tTexas\t40\t1
2020-03-08\tAlpha\tNowhere\t0\t0
2020-03-10\tKings\tNew York\t260\t13
2020-03-10\tQueens\tNew York\t260\t8
2020-03-10\tHarris\tTexas\t45\t1
2020-03-10\tAlpha\tNowhere\t0\t1
"""

BAD_TSV = """\
2020-03-01\tKings\tNew York\t10\t0
2020-13-45\tKings\tNew York\t20\t0
2020-03-03\tKings\tNew York\tabc\t0
"""


@pytest.fixture(scope="session")
def hand_path(tmp_path_factory):
    p = tmp_path_factory.mktemp("hand") / "obs.tsv"
    p.write_text(HAND_TSV)
    return str(p)


@pytest.fixture(scope="session")
def bad_path(tmp_path_factory):
    p = tmp_path_factory.mktemp("bad") / "obs.tsv"
    p.write_text(BAD_TSV)
    return str(p)


@pytest.fixture(scope="session")
def hand_sd(spark, hand_path):
    from cumulus.operators.stages import group_day
    from cumulus.sources.observations import read_obs
    return group_day(read_obs(spark, hand_path)).cache()
