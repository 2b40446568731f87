"""Column naming of the observation table.

Every operator works on canonical names (``date``, ``state``, ``total_cases``
...) after the first stage; ``ObsColumns`` maps a user's table onto them so the
same marts run on any (time, unit, group, measure, measure) layout.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ObsColumns:
    time: str = "date"      # daily grain, DateType
    unit: str = "county"    # entity that reports a cumulative count
    group: str = "state"    # level the marts are computed at
    cases: str = "cases"    # first cumulative measure
    deaths: str = "deaths"  # second cumulative measure


OBS_COLUMNS = ObsColumns()
