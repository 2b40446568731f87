"""cumulus: cumulative-count analytics expressed as Spark DataFrame plans.

Input is a table of cumulative counts observed per (time, unit, group); the
library sums it to group-days, differences it into increments and derives
totals, snapshots, rates, rankings, rolling statistics, growth, doubling
times, Pareto shares, lagged correlation, anomalies, centroids, aligned
curves and k-means tiers.  Everything is DataFrame code planned by Catalyst.
"""

from cumulus.columns import ObsColumns, OBS_COLUMNS

__all__ = ["ObsColumns", "OBS_COLUMNS"]
