"""Outlying run records by minimum-covariance-determinant estimates, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popstat.session import cut_lineage

DIMENSIONS = 4
#: Statistics are clipped to this range and kept as whole numbers of 1/UNIT: their sums are exact in any order.
LARGEST, UNIT = 16.0, 1024
KEEP = 0.75
STEPS = 8
STARTS = 2
SMALL_GROUP = 50
#: Upper tail of the chi-squared distribution beyond which a vector is rejected.
TAIL = 1e-3
WHITE_SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _chi_squared(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    terms = [(x / 2) ** k / math.factorial(k) for k in range(degrees // 2)]
    return 1 - math.exp(-x / 2) * sum(terms)


def _chi_squared_point(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_squared(middle, degrees) < p else (low, middle)
    return low


def text_statistics(logs: DataFrame, log: str) -> DataFrame:
    """``logs`` with the counts n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the text ``log``."""
    text = F.coalesce(F.col(log).cast("string"), F.lit(""))
    spaced = F.translate(text, WHITE_SPACE, " " * len(WHITE_SPACE))
    with_word = lambda line: F.length(F.translate(line, WHITE_SPACE, "")) > 0
    counted = logs.select(
        "*",
        F.filter(F.split(spaced, " "), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), with_word).alias("_lines"),
        F.length(F.translate(text, WHITE_SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    # Three-word windows as (64-bit hash, place), sorted: equal ones become neighbours
    word = lambda i, k: F.get("_words", i + k)
    places = F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(
        places, lambda i: F.struct(F.xxhash64(word(i, 0), word(i, 1), word(i, 2)).alias("h"), i.alias("i"))
    )
    sorted_ = counted.select(
        *logs.columns, "word_chars", "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("_windows"),
    )
    other = lambda k: F.get("_windows", k)["h"]
    twice = F.transform(
        "_windows", lambda w, k: F.when((w["h"] == other(k - 1)) | (w["h"] == other(k + 1)), w["i"])
    )
    found = sorted_.withColumn("_twice", F.sort_array(F.filter(twice, lambda p: p.isNotNull())))
    covered = F.aggregate(
        F.transform("_twice", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_twice", k + 1) - p, F.lit(3)))),
        F.lit(0), lambda total, n: total + n,
    )
    return found.withColumn("n_repeat_words", covered.cast("long")).drop("_windows", "_twice")


def _inverse(a: Mapping[tuple[int, int], Column]) -> tuple[dict[tuple[int, int], Column], Column]:
    """Inverse, upper triangle, and determinant of a symmetric matrix of four rows, by its 2x2 minors."""
    m = lambda i, j: a[min(i, j), max(i, j)]
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    minor = lambda r, s: {(i, j): m(r, i) * m(s, j) - m(s, i) * m(r, j) for i, j in pairs}
    top, low = minor(0, 1), minor(2, 3)
    rest = {p: tuple(k for k in range(4) if k not in p) for p in pairs}
    sign = {(0, 1): 1, (0, 2): -1, (0, 3): 1, (1, 2): 1, (1, 3): -1, (2, 3): 1}
    det = sum((top[p] * low[rest[p]] * F.lit(sign[p]) for p in pairs[1:]), top[pairs[0]] * low[rest[pairs[0]]])
    out = {}
    for i in range(4):
        for j in range(i, 4):
            rows = [k for k in range(4) if k != j]
            cols = [k for k in range(4) if k != i]
            x, y, z = rows
            p, q, r = cols
            cofactor = (
                m(x, p) * (m(y, q) * m(z, r) - m(y, r) * m(z, q))
                - m(x, q) * (m(y, p) * m(z, r) - m(y, r) * m(z, p))
                + m(x, r) * (m(y, p) * m(z, q) - m(y, q) * m(z, p))
            )
            out[i, j] = cofactor * F.lit((-1) ** (i + j)) / det
    return out, det


UPPER = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
_SUMS = ["n", *[f"s{i}" for i in range(DIMENSIONS)], *[f"s{i}{j}" for i, j in UPPER]]


def _moments() -> list[Column]:
    """Count, sums and sums of products; whole numbers, so the same in any order."""
    return [
        F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMENSIONS)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in UPPER],
    ]


def _estimates(moments: DataFrame, keys: Sequence[str], floors: Sequence[float], scale: float) -> DataFrame:
    """Centre ``m*``, inverse covariance ``w*`` and determinant of each row of moments."""
    n = F.col("n").cast("double")
    mean = lambda i: F.col(f"s{i}").cast("double") / n
    covariance = moments.select(*keys, *[(mean(i) / UNIT).alias(f"m{i}") for i in range(DIMENSIONS)], *[
        (F.greatest(F.col(f"s{i}{j}").cast("double") / n - mean(i) * mean(j), F.lit(0.0)) if i == j else
         F.col(f"s{i}{j}").cast("double") / n - mean(i) * mean(j)).alias(f"c{i}{j}") for i, j in UPPER
    ])
    matrix = {
        (i, j): F.col(f"c{i}{j}") * F.lit(scale / UNIT**2) + F.lit(floors[i] ** 2 if i == j else 0.0) for i, j in UPPER
    }
    inverse, det = _inverse(matrix)
    return covariance.select(
        *keys, *[f"m{i}" for i in range(DIMENSIONS)], *[inverse[p].alias(f"w{p[0]}{p[1]}") for p in UPPER], det.alias("det")
    )


def _distance() -> Column:
    """Squared Mahalanobis distance of x* from the joined estimate."""
    z = [F.col(f"x{i}") / F.lit(float(UNIT)) - F.col(f"m{i}") for i in range(DIMENSIONS)]
    terms = [z[i] * z[j] * F.col(f"w{i}{j}") * F.lit(1.0 if i == j else 2.0) for i, j in UPPER]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _pools(vectors: DataFrame, by: Sequence[str]) -> DataFrame:
    """Vectors with their group ``g*``: small groups of one first key are pooled, then small first keys."""
    first, second = by
    sizes = vectors.groupBy(first, second).agg(F.count(F.lit(1)).alias("_n"))
    is_small = F.col("_n") < SMALL_GROUP
    of_first = Window.partitionBy(first)
    left = F.sum(F.when(is_small, F.col("_n"))).over(of_first)
    level = F.when(~is_small, F.lit(0)).when(left >= SMALL_GROUP, F.lit(1)).otherwise(F.lit(2))
    named = sizes.select(F.col(first).alias("_f"), F.col(second).alias("_s"), level.alias("g0")).select(
        "_f", "_s", "g0", F.when(F.col("g0") < 2, F.col("_f").cast("string")).alias("g1"),
        F.when(F.col("g0") < 1, F.col("_s").cast("string")).alias("g2"),
    )
    named = cut_lineage(named)
    same = vectors[first].eqNullSafe(named["_f"]) & vectors[second].eqNullSafe(named["_s"])
    return vectors.join(named, same).drop("_f", "_s")


GROUP = ["g0", "g1", "g2"]


def _with(rows: DataFrame, estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the estimates of their group; keys may be NULL."""
    renamed = estimates.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in estimates.columns])
    same = [rows[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return rows.join(renamed, condition).drop(*[f"_{k}" for k in keys])


def _medians(vectors: DataFrame) -> DataFrame:
    """Lower median ``m*`` of each x* of a group, from counts of its values, which are whole and clipped."""
    long = vectors.select(*GROUP, F.posexplode(F.array(*[f"x{i}" for i in range(DIMENSIONS)])).alias("i", "x"))
    counts = long.groupBy(*GROUP, "i", "x").agg(F.count(F.lit(1)).alias("n"))
    of_statistic = Window.partitionBy(*GROUP, "i")
    upto = F.sum("n").over(of_statistic.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    half = counts.select("*", upto.alias("upto"), F.sum("n").over(of_statistic).alias("all")).where("2 * upto >= all")
    lowest = half.groupBy(*GROUP, "i").agg(F.min("x").alias("x"))
    return lowest.groupBy(*GROUP).agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"m{i}") for i in range(DIMENSIONS)])


def covariance_estimates(vectors: DataFrame, floors: Sequence[float]) -> DataFrame:
    """Regularised minimum-covariance-determinant estimate of each group of ``vectors`` (g*, x*).

    Two starts, the plain moments and the rows nearest the median, are improved by STEPS
    concentration steps: the KEEP share of rows with the smallest distances gives the next
    estimate. A step is one aggregation by (group, start, bin of distance), whose sums are
    added up to the bin that reaches the share, so its cost does not depend on how rows
    spread over groups. The start with the smaller determinant wins. ``floors`` are
    standard deviations added to each statistic's own, as most texts agree in some.
    """
    keys = [*GROUP, "start"]
    own = KEEP / _chi_squared(_chi_squared_point(KEEP, DIMENSIONS), DIMENSIONS + 2)
    plain = _estimates(vectors.groupBy(*GROUP).agg(*_moments()), GROUP, floors, 1.0).withColumn("start", F.lit(0))
    middle = _medians(vectors).select(
        *GROUP, *[(F.col(f"m{i}") / F.lit(float(UNIT))).alias(f"m{i}") for i in range(DIMENSIONS)],
        *[F.lit(1 / floors[i] ** 2 if i == j else 0.0).alias(f"w{i}{j}") for i, j in UPPER],
        F.lit(math.inf).alias("det"), F.lit(1).alias("start"),
    )
    estimates = cut_lineage(plain.unionByName(middle))
    for _ in range(STEPS):
        bins = F.floor(F.log1p(F.col("d2")) * 256).cast("int")
        placed = _with(vectors, estimates, GROUP).withColumn("d2", _distance()).withColumn("bin", bins)
        sums = placed.groupBy(*keys, "bin").agg(*_moments())
        ahead = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = sums.select(
            "*", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy(*keys)).alias("all")
        )
        near = counted.where(F.col("ahead") < F.ceil(F.col("all") * F.lit(KEEP)))
        total = near.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])
        estimates = cut_lineage(_estimates(total, keys, floors, own))
    best = F.row_number().over(Window.partitionBy(*GROUP).orderBy("det", "start"))
    return cut_lineage(estimates.withColumn("_best", best).where("_best = 1").drop("_best", "start"))


def robust_distances(
    runs: DataFrame, statistics: Mapping[str, Column], floors: Sequence[float],
    by: Sequence[str] = ("case_label", "variant"), usable: Column | None = None,
) -> DataFrame:
    """``runs`` with the squared robust distance ``d2`` of four transformed statistics, NULL where not ``usable``.

    ``statistics`` names four columns to be computed, for instance logarithms of
    avg_sec_per_gen, total_sec, peak_rss_kb and peak_vmsize_kb; they are clipped to
    +-LARGEST and kept in steps of 1/UNIT. Estimates are per group of ``by`` (two columns,
    NULL is a value of its own); groups under SMALL_GROUP rows are pooled within the first
    column, and such pools with each other. A row with a missing statistic is not usable.
    """
    if len(statistics) != DIMENSIONS or len(by) != 2:
        raise ValueError("four statistics and two grouping columns")
    clipped = [F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST))) for c in statistics.values()]
    whole = [F.round(c * UNIT).cast("long").alias(f"x{i}") for i, c in enumerate(clipped)]
    known = F.lit(True) if usable is None else F.coalesce(usable, F.lit(False))
    rows = runs.select("*", *[F.when(known, w).alias(f"x{i}") for i, w in enumerate(whole)])
    complete = F.lit(True)
    for i in range(DIMENSIONS):
        complete = complete & F.col(f"x{i}").isNotNull()
    rows = cut_lineage(rows.withColumn("_complete", complete))
    vectors = cut_lineage(_pools(rows.where("_complete"), by))
    estimates = covariance_estimates(vectors.select(*GROUP, *[f"x{i}" for i in range(DIMENSIONS)]), floors)
    columns = [c for c in runs.columns]
    judged = _with(vectors, estimates, GROUP).select(*columns, _distance().alias("d2"))
    return judged.unionByName(rows.where("not _complete").select(*columns, F.lit(None).cast("double").alias("d2")))


def judge_logs(
    logs: DataFrame, by: Sequence[str] = ("case_label", "variant"), run_id: str = "run_id", log: str = "log"
) -> DataFrame:
    """Which captured logs look like the others of their group.

    ``logs`` has ``run_id``, the whole text ``log`` and two grouping columns. Result, one row
    per input row: ``run_id``, the counts of :func:`text_statistics`, ``base_failed`` (under
    50 words, or more than half of the words in repeated three-word windows), ``d2`` and
    ``kept``. Logs that fail the base take no part in the estimates. Vectors are the
    logarithm of the mean word length and the square roots of symbols, repeated lines and
    repeated words per word; a log is kept if its robust distance is within the
    1 - TAIL point of the chi-squared distribution. A NULL log has no words and fails the
    base; repeated rows count as rows; other columns are ignored; empty tables give no rows.
    """
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    named = logs.select(F.col(run_id).alias("_run"), *keys, F.col(log).alias("_log"))
    counts = text_statistics(named, "_log").drop("_log")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = counts.withColumn("base_failed", failed)
    per_word = lambda c: F.sqrt(F.try_divide(F.col(c).cast("double"), F.col("n_words").cast("double")))
    statistics = {
        "length": F.log(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double"))),
        **{c: per_word(c) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")},
    }
    judged = robust_distances(counts, statistics, FLOORS, ("_by0", "_by1"), ~F.col("base_failed"))
    limit = _chi_squared_point(1 - TAIL, DIMENSIONS)
    return judged.select(
        F.col("_run").alias(run_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(False))).alias("kept"), "d2",
    )


#: Least standard deviations of log mean word length and of root symbols, repeated lines and repeated words per word.
#: In a group whose texts all agree, each rejects by itself at the cut of 4.3 of them: words longer by two fifths, five
#: symbols or five repeated lines in a hundred words, a fifth of the words repeated (the base fails at a half).
FLOORS = (0.08, 0.05, 0.05, 0.10)
