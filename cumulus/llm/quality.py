"""Operator 5: quality rules by robust multivariate outliers, in DataFrame functions only.

A text's statistics are counted whole.  Two plain rules come first (too few words,
too many repeated words).  The others become a vector of transformed statistics per
document; for every language and source a minimum-covariance-determinant estimate
is made of the documents that pass the plain rules: from two starts (medians with
absolute deviations, and plain moments) a few concentration steps keep the share of
documents that lie closest and re-estimate mean and covariance from them; the start
with the smaller determinant wins.  Documents far from their group by Mahalanobis
distance are rejected.  Rows carry a salt beside their group, so a group with a
third of all documents is spread; all group sums are combined before the shuffle.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulus.llm.staging import staged

# ---- fixed values of the plain rules -----------------------------------------------------
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

SHARE = 0.75          # documents of a group that a concentration step keeps
STEPS = 3             # concentration steps
ACCURACY = 1000       # of quantiles: their rank is off by at most 1 / ACCURACY of a group
PRIOR = 50            # weight, in documents, of the language's estimate in a source's covariance
CENTRE_PRIOR = 5      # the same for its centre: a document alone in its group is not its own measure
CUTOFF = 1 - 1e-6     # of the chi-square distribution of squared distances
SALTS = 64

#: Transformed statistics, and the standard deviation below which a group's spread is not
#: believed (clean texts often agree in a statistic altogether).  x_lines and x_repeats are the
#: logarithms of how often a line stands there on average, and of all words by those outside of
#: repeated windows: they grow without bound, so that either alone can pass the cut.
FEATURES = {
    "x_words": ("ln(1.0D + n_words)", 0.5),
    "x_length": ("ln(1.0D + word_chars / greatest(n_words, 1))", 0.08),
    "x_symbols": ("ln(1.0D + 100.0D * n_symbols / greatest(n_words, 1))", 0.3),
    "x_lines": ("ln(greatest(n_lines, 1) / cast(greatest(n_lines - n_dup_lines, 1) AS double))", 0.08),
    "x_repeats": ("ln(greatest(n_words, 1) / cast(greatest(n_words - n_repeat_words, 1) AS double))", 0.08),
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) of whole texts.

    Words are runs without space and U+0009 to U+000D.  n_lines counts lines with a
    word; n_dup_lines those equal to an earlier one.  n_repeat_words counts words that
    stand in a window of three words found twice or more.  A null text has none.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    counted = docs.select(
        *kept,
        F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+", -1), "").alias("__words"),
        F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(whole, "\n", -1), lambda line: F.length(F.translate(line, SPACES, "")) > 0).alias("__lines"))
    # A window's key is its hash, whose low bits give way to its place; sorted keys put equal windows
    # side by side (compared word by word then), and a repeated window covers up to three new words.
    keys = F.expr("""
        CASE WHEN size(__words) >= 3 THEN
          sort_array(transform(sequence(0, size(__words) - 3), i ->
            (xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2))
              & ~(shiftleft(1L, length(bin(size(__words)))) - 1L)) | cast(i AS bigint)))
        ELSE cast(array() AS array<bigint>) END""")
    counted = counted.select("*", keys.alias("__keys"))
    place = "cast({k} & (shiftleft(1L, length(bin(size(__words)))) - 1L) AS int)"
    same = ("(coalesce(shiftright(get(__keys, {j}), length(bin(size(__words)))) = "
            "shiftright(x, length(bin(size(__words)))), false) AND "
            + " AND ".join(f"get(__words, {place.format(k='x')} + {d}) = get(__words, "
                           f"{place.format(k='get(__keys, {j})')} + {d})" for d in range(3)) + ")")
    repeated = F.expr(f"""
        sort_array(transform(filter(__keys, (x, k) -> {same.format(j='k - 1')} OR {same.format(j='k + 1')}),
                             x -> {place.format(k='x')}))""")
    counted = counted.select("*", repeated.alias("__at"))
    covered = F.expr("""
        aggregate(transform(__at, (p, k) -> least(3, coalesce(get(__at, k + 1) - p, 3))), 0L, (a, b) -> a + b)""")
    return counted.select(
        *kept, F.size("__words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"))


def chi_square_quantile(p: float, k: int) -> float:
    """Quantile of the chi-square distribution with k degrees (Wilson and Hilferty)."""
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * (2 / (9 * k)) ** 0.5) ** 3


def chi_square_share(x: float, k: int) -> float:
    """Distribution function of the chi-square distribution with k degrees (Wilson and Hilferty)."""
    return NormalDist().cdf(((x / k) ** (1 / 3) - 1 + 2 / (9 * k)) / (2 / (9 * k)) ** 0.5)


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _precision(groups: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Add the inverse p_i_j and the log determinant ``logdet`` of the covariances s_i_j (i >= j)."""
    d = len(names)
    for j in range(d):
        below = _total([F.col(f"l_{j}_{k}") ** 2 for k in range(j)]) if j else F.lit(0.0)
        groups = groups.withColumn(f"l_{j}_{j}", F.sqrt(F.col(f"s_{j}_{j}") - below))
        for i in range(j + 1, d):
            part = _total([F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)]) if j else F.lit(0.0)
            groups = groups.withColumn(f"l_{i}_{j}", (F.col(f"s_{i}_{j}") - part) / F.col(f"l_{j}_{j}"))
    for j in range(d):
        groups = groups.withColumn(f"v_{j}_{j}", 1 / F.col(f"l_{j}_{j}"))
        for i in range(j + 1, d):
            part = _total([F.col(f"l_{i}_{k}") * F.col(f"v_{k}_{j}") for k in range(j, i)])
            groups = groups.withColumn(f"v_{i}_{j}", -part / F.col(f"l_{i}_{i}"))
    inverse = [_total([F.col(f"v_{k}_{i}") * F.col(f"v_{k}_{j}") for k in range(i, d)]).alias(f"p_{i}_{j}")
               for i in range(d) for j in range(i + 1)]
    logdet = (2 * _total([F.log(F.col(f"l_{j}_{j}")) for j in range(d)])).alias("logdet")
    return groups.select(*keep, *[f"m_{i}" for i in range(d)], *inverse, logdet)


def _distance(names: list[str], prefix: str = "") -> Column:
    """Squared Mahalanobis distance of a row from its group's estimate."""
    gap = [F.col(n) - F.col(f"{prefix}m_{i}") for i, n in enumerate(names)]
    return _total([gap[i] * gap[j] * F.col(f"{prefix}p_{i}_{j}") * (1 if i == j else 2)
                   for i in range(len(names)) for j in range(i + 1)])


GROUP = ["g_lang", "g_source"]
START = [*GROUP, "start"]      # estimates of the two starts go through the steps side by side


def _salted(groups: DataFrame) -> DataFrame:
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _moments(rows: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """Mean and covariance of the rows per group and start, both drawn to the language's.

    The floors' squares are added to the variances, so no covariance is singular.
    """
    d = len(names)
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(n).alias(f"t_{i}") for i, n in enumerate(names)] + [
        F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q_{i}_{j}") for i in range(d) for j in range(i + 1)]
    by_group = rows.groupBy(*START).agg(*sums)

    def scatter(i: int, j: int) -> Column:
        return F.col(f"q_{i}_{j}") - F.col(f"t_{i}") * F.col(f"t_{j}") / F.col("n")

    scatters = [scatter(i, j).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)]
    own = by_group.select(*START, "n", *[f"t_{i}" for i in range(d)], *scatters)
    pooled = own.groupBy("g_lang", "start").agg(F.sum("n").alias("nl"), *[F.sum(f"t_{i}").alias(f"u_{i}") for i in range(d)], *[
        F.sum(f"c_{i}_{j}").alias(f"b_{i}_{j}") for i in range(d) for j in range(i + 1)])
    both = own.join(pooled, ["g_lang", "start"])
    drawn = [((F.col(f"c_{i}_{j}") + PRIOR * F.col(f"b_{i}_{j}") / F.col("nl")) / (F.col("n") + PRIOR)
              + (F.lit(floors[i] ** 2) if i == j else F.lit(0.0))).alias(f"s_{i}_{j}")
             for i in range(d) for j in range(i + 1)]
    centre = [((F.col(f"t_{i}") + CENTRE_PRIOR * F.col(f"u_{i}") / F.col("nl")) / (F.col("n") + CENTRE_PRIOR)).alias(f"m_{i}")
              for i in range(d)]
    return both.select(*START, *centre, *drawn)


def estimates(rows: DataFrame, features: dict[str, tuple[str, float]] = FEATURES) -> DataFrame:
    """Minimum-covariance-determinant estimates per group of salted ``rows``.

    Returns the group's columns, centre m_i and inverse covariance p_i_j.
    """
    names, floors = list(features), [f for _, f in features.values()]
    d = len(names)
    near = chi_square_quantile(SHARE, d)
    factor = SHARE / chi_square_share(near, d + 2)     # makes the concentrated covariance consistent
    centre = rows.groupBy(*GROUP).agg(*[F.percentile_approx(n, 0.5, ACCURACY).alias(f"m_{i}") for i, n in enumerate(names)])
    centred = rows.join(_salted(centre), [*GROUP, "salt"])
    spread = centred.groupBy(*GROUP).agg(
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(d)],
        *[F.percentile_approx(F.abs(F.col(n) - F.col(f"m_{i}")), 0.5, ACCURACY).alias(f"a_{i}") for i, n in enumerate(names)])
    medians = spread.select(*GROUP, F.lit(0).alias("start"), *[f"m_{i}" for i in range(d)], *[
        (F.col(f"a_{i}") ** 2 * 2.2 + floors[i] ** 2 if i == j else F.lit(0.0)).alias(f"s_{i}_{j}")
        for i in range(d) for j in range(i + 1)])
    plain = _moments(rows.withColumn("start", F.lit(1)), names, floors)
    groups = staged(_precision(medians.unionByName(plain), names, START), "estimate")
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(STEPS):
        far = both.join(_salted(groups), [*START, "salt"]).select(*START, "salt", *names, _distance(names).alias("d2"))
        limit = far.groupBy(*START).agg(F.percentile_approx("d2", SHARE, ACCURACY).alias("limit"))
        core = far.join(_salted(limit), [*START, "salt"]).where("d2 <= limit")
        groups = staged(_precision(_moments(core, names, floors), names, START), "estimate")
    held = [c for c in groups.columns if c[:2] in ("m_", "p_")]
    best = groups.groupBy(*GROUP).agg(F.min(F.struct("logdet", "start", *held)).alias("e"))
    return best.select(*GROUP, *[(F.col(f"e.{c}") / factor if c[0] == "p" else F.col(f"e.{c}")).alias(c) for c in held])


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          keep: list[str] | None = None) -> DataFrame:
    """Statistics and verdict of every row: the columns ``keep``, the counts of ``statistics``,
    base_failed, distance (squared, null if base_failed) and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated windows;
    so null and empty texts fail.  Null languages and sources count as ''.  Repeated
    rows weigh as often as they stand there, ties are judged alike.  Kept columns
    that have the name of an added one are replaced; an empty table gives an empty
    table.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
             "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source_rows = docs.select(
        *[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)], F.col(text).alias("text"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("g_lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("g_source"))
    counted = statistics(source_rows).drop("text")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed).withColumn("salt", (F.rand(7) * SALTS).cast("int"))
    counted = staged(counted.select("*", *[F.expr(e).alias(n) for n, (e, _) in FEATURES.items()]), "statistics")
    passed = counted.where("NOT base_failed")
    groups = staged(estimates(passed.select(*GROUP, "salt", *FEATURES)), "estimate")
    names = list(FEATURES)
    far = F.when(~F.col("base_failed"), _distance(names))
    cutoff = chi_square_quantile(CUTOFF, len(names))
    out = counted.join(_salted(groups), [*GROUP, "salt"], "left").withColumn("distance", far)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cutoff))
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], *added)
