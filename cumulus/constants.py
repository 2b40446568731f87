"""Fixed values of the original analyses, kept together.

Results only agree with the original outputs if these equal the original
jobs' values.  Operators take them as parameter defaults; pass others to change them.
"""

# ---- Fixed values: marts, in the order of the result tables ----------------------
TOP_N = 10                # snapshot top/bottom lists (R4-R7), monthly top list (R12)
OVERALL_LABEL = "USA"     # group label of the overall row (R8)
ROLLING_ROWS = 7          # rolling-mean frame, current row included (R9)
LEAD_ROWS = 10            # rows by which deaths lead cases in the correlation (R17)
TRAILING_ROWS = 14        # rows before the current one in the z-score baseline (R18)
DAY0_THRESHOLD = 100      # cumulative count that defines day 0 (R20)
KMEANS_K = 4              # number of risk clusters (R21)
KMEANS_SEED = 2020        # k-means seed (R21)
RT_ROWS = 7               # length of each period of the reproduction ratio (R22)
RT_FLOOR = 50             # the earlier period's sum must exceed this (R22)

# ---- Fixed values: data-shaping views -----------------------------------------------
TOP5_N = 5                # top-5 panels (V3)
PEAK_TOP_N = 15           # largest peaks (V7)
FASTEST_TOP_N = 15        # fastest doubling (V12)
ROLLING_TOP_N = 20        # latest rolling means (V6)
PARETO_TOP_N = 20         # Pareto chart rows (V14)
PARETO_CUT = 0.8          # Pareto threshold line (V14)
AXIS_HEADROOM = 1.2       # weekday radar axis = headroom x largest mean (V10)
ANOMALY_Z = 0.5           # z-score above which a point is flagged (V16)
MIN_STEP_DEGREES = 1.0    # trajectory thinning distance (V17)
RT_LEVEL = 1.0            # reproduction threshold line (V21)

# Severity bins of the snapshot map (V2), as (upper edges, labels), right-closed.
SEVERITY_BINS = {
    "total_cases": ([30000, 60000, 100000, 200000], ["<3w", "3w-6w", "6w-10w", "10w-20w", ">20w"]),
    "total_deaths": ([1000, 5000, 10000, 20000], ["<1k", "1k-5k", "5k-10k", "10k-20k", ">20k"]),
    "death_rate": ([0.03, 0.05, 0.07, 0.09], ["<3%", "3%-5%", "5%-7%", "7%-9%", ">9%"]),
}

# Display divisors of the top-5 panels (V3): cases in 10k, deaths as is, rate in %.
TOP5_DIVISORS = {"total_cases": 10000.0, "total_deaths": 1.0, "death_rate": 0.01}

# Weekday names in Monday-first order.
WEEK_ORDER = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Gauge colour bands of the correlation dial (V15): upper edges on a 0-100 scale, labels.
CORRELATION_BANDS = ([30, 70], ["low", "medium", "high"])

# Risk tier names (V20), lowest risk first.
TIER_NAMES = ("low", "medium", "high", "very high")

# The twelve located groups of the original centroid job (name, lat, lon).
REFERENCE_COORDS = [
    ("New York", 40.71, -74.00), ("California", 36.77, -119.41), ("Illinois", 40.63, -89.39),
    ("Texas", 31.96, -99.90), ("Florida", 27.66, -81.51), ("Massachusetts", 42.40, -71.38),
    ("New Jersey", 40.05, -74.40), ("Pennsylvania", 41.20, -77.19), ("Washington", 47.75, -120.74),
    ("Georgia", 32.16, -82.90), ("Michigan", 44.31, -85.60), ("Louisiana", 31.16, -91.87),
]
