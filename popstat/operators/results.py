"""Analytics on run-result tables: replicates, references, distributions, speed, phases.

All tables are long: one row per run and metric. A value that does not exist is
``missing`` (NaN unless the caller wants None for NULL).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popstat.functions.scalars import error_band, rel_diff
from popstat.functions.text import MINOR_PHASES, PHASE_GROUPS, label
from popstat.operators.filters import BIOLOGICAL_METRICS

NAN = float("nan")
Keys = Sequence[str]


def _sd(value: Column) -> Column:
    """Sample deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def _missing(value) -> Column:
    return F.lit(value).cast("double")


# ---- replicates ----------------------------------------------------------------


def replicate_summary(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """n_reps, mean and sample sd per key."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(v).alias("n_reps"), F.avg(v).alias("mean"), _sd(v).alias("sd"))


def _optional(text: str, missing) -> tuple[Column, Column]:
    v = F.col(text).try_cast("double")
    none = F.count(v) == 0
    return (
        F.when(none, _missing(missing)).otherwise(F.avg(v)),
        F.when(none, _missing(missing)).otherwise(_sd(v)),
    )


def optional_summary(df: DataFrame, keys: Keys, value: str, missing=NAN) -> DataFrame:
    """Mean and sd over the values that are numbers; ``missing`` where there is none."""
    mean, sd = _optional(value, missing)
    return df.groupBy(*keys).agg(mean.alias("mean"), sd.alias("sd"))


def speed_summary(runs: DataFrame, keys: Keys, missing=NAN) -> DataFrame:
    """Speed, total time and memory of each configuration in one pass."""
    columns = [F.count(F.lit(1)).alias("n_reps")]
    for name in ("ms_per_gen", "total_sec"):
        v = F.col(name).cast("double")
        columns += [F.avg(v).alias(f"mean_{name}"), _sd(v).alias(f"sd_{name}")]
    for name in ("peak_rss_kb", "peak_vmsize_kb"):
        mean, sd = _optional(name, missing)
        columns += [mean.alias(f"mean_{name}"), sd.alias(f"sd_{name}")]
    return runs.groupBy(*keys).agg(*columns)


def union_results(dfs: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables under the union of their columns, first seen first."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def last_wins(df: DataFrame, key: Keys, order: Keys) -> DataFrame:
    """One row per key, the latest; partial results are combined before the shuffle."""
    rest = [c for c in df.columns if c not in key and c not in order]
    latest = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return latest.select(*key, "_row.*").select(*df.columns)


# ---- accuracy ------------------------------------------------------------------


def compare_to_reference(
    summary: DataFrame, reference: str, keys: Keys = ("case_label", "metric"), simulator: str = "simulator"
) -> DataFrame:
    """Each candidate summary beside the reference's; candidates without one are dropped."""
    ref = summary.where(F.col(simulator) == reference).select(
        *keys, F.col("mean").alias("ref_mean"), F.col("sd").alias("ref_sd"), F.col("n_reps").alias("ref_n")
    )
    candidates = summary.where(F.col(simulator) != reference)
    return candidates.join(ref, list(keys)).select(
        *candidates.columns, "ref_mean", "ref_sd", "ref_n",
        F.abs(F.col("mean") - F.col("ref_mean")).alias("abs_diff"),
        rel_diff("mean", "ref_mean").alias("rel_diff"),
    )


def mean_vector(df: DataFrame, keys: Keys, values: str) -> DataFrame:
    """Element-wise mean of integer or float arrays of unequal length, in long form (keys, pos, mean_value).

    Short arrays count as padded with 0: the divisor is the number of arrays of the key.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    items = df.select(*keys, F.posexplode(values).alias("pos", "_v"))
    sums = items.groupBy(*keys, "pos").agg(F.sum(F.col("_v").cast("double")).alias("_sum"))
    return sums.join(n, list(keys)).select(*keys, "pos", (F.col("_sum") / F.col("_n")).alias("mean_value"))


def collect_vector(df: DataFrame, keys: Keys, pos: str, value: str, name: str) -> DataFrame:
    """Long form back to one ordered array per key, for a sink that needs it in one field."""
    pairs = F.array_sort(F.collect_list(F.struct(pos, value)))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def normalized_distribution(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Share of the total of the key; all 0 where the total is not positive."""
    totals = df.groupBy(*keys).agg(F.sum(F.col(value).cast("double")).alias("_total"))
    share = F.when(F.col("_total") > 0.0, F.col(value).cast("double") / F.col("_total")).otherwise(F.lit(0.0))
    return df.join(totals, list(keys)).select(*df.columns, share.alias("share"))


def distribution_distance(a: DataFrame, b: DataFrame, keys: Keys, pos: str = "pos", value: str = "share") -> DataFrame:
    """Total variation distance and largest bin difference; absent bins count as 0."""
    on = [*keys, pos]
    left = a.select(*on, F.col(value).alias("_a"))
    right = b.select(*on, F.col(value).alias("_b"))
    gap = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return (
        left.join(right, on, "full")
        .groupBy(*keys)
        .agg((F.lit(0.5) * F.sum(gap)).alias("tvd"), F.max(gap).alias("max_bin_abs_diff"))
    )


def total_variation_distance(a, b, keys: Keys, pos: str = "pos", value: str = "share") -> DataFrame:
    return distribution_distance(a, b, keys, pos, value).select(*keys, "tvd")


def max_abs_bin_diff(a, b, keys: Keys, pos: str = "pos", value: str = "share") -> DataFrame:
    return distribution_distance(a, b, keys, pos, value).select(*keys, "max_bin_abs_diff")


MAXIMA = ("max_scalar_rel_diff", "max_vector_tvd")
#: What is told of a variant in comparisons and overviews.
VARIANT_META = ("scenario_description", "alias_builder", "threads")


def with_meta(summary: DataFrame, rows: DataFrame, keys: Keys, names: Keys = VARIANT_META) -> DataFrame:
    """``summary`` with what the rows of a key say of it; rows of one key agree, so any is as good."""
    meta = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in names])
    return summary.join(meta, list(keys), "left")


def merge_variant_maxima(scalar: DataFrame, vector: DataFrame, variant: str = "variant") -> DataFrame:
    """Worst scalar error beside worst vector distance of each variant, absent ones 0.

    What else is known of a variant on either side, its builder and threads say, is kept.
    """
    zero = F.lit(0.0)
    known = [c for c in dict.fromkeys([*scalar.columns, *vector.columns]) if c not in (variant, *MAXIMA)]
    either = [F.coalesce(*[d[c] for d in (scalar, vector) if c in d.columns]).alias(c) for c in known]
    return scalar.join(vector, variant, "full").select(
        variant, *either,
        F.coalesce("max_scalar_rel_diff", zero).alias("max_scalar_rel_diff"),
        F.coalesce("max_vector_tvd", zero).alias("max_vector_tvd"),
    )


def worst_error_per_variant(
    comparison: DataFrame, distances: DataFrame, metrics=BIOLOGICAL_METRICS, variant: str = "variant"
) -> DataFrame:
    """Largest relative error over the biological metrics and largest distance, per variant, with its builder and threads."""
    meta = lambda df: [F.max(c).alias(c) for c in ("alias_builder", "threads") if c in df.columns]
    counted = F.when(F.col("metric").isin(*metrics), F.col("rel_diff"))
    scalar = comparison.groupBy(variant).agg(*meta(comparison), F.max(counted).alias("max_scalar_rel_diff"))
    vector = distances.groupBy(variant).agg(*meta(distances), F.max("tvd").alias("max_vector_tvd"))
    return merge_variant_maxima(scalar, vector, variant)


def accuracy_grid(comparison: DataFrame, metrics: Sequence = BIOLOGICAL_METRICS, banded: bool = False) -> DataFrame:
    """Case x metric matrix of mean relative errors, or of their bands."""
    grid = comparison.groupBy("case_label").pivot("metric", list(metrics)).agg(F.avg("rel_diff"))
    if not banded:
        return grid
    return grid.select("case_label", *[error_band(f"`{m}`").alias(str(m)) for m in metrics])


# ---- speed and scaling ---------------------------------------------------------


def best_config(summary: DataFrame, keys: Keys = ("case_label", "alias_builder")) -> DataFrame:
    """Per key the thread count with the lowest mean time; the smaller count wins a tie."""
    row = F.struct("mean_ms_per_gen", "threads", "sd_ms_per_gen")
    return summary.groupBy(*keys).agg(F.min(row).alias("_best")).select(
        *keys,
        F.col("_best.threads").alias("best_threads"),
        F.col("_best.mean_ms_per_gen").alias("best_mean_ms_per_gen"),
        F.col("_best.sd_ms_per_gen").alias("best_sd_ms_per_gen"),
    )


def attach_reference_speed(best: DataFrame, reference: DataFrame, missing=NAN) -> DataFrame:
    """Reference time and speedup beside the best configuration of each case."""
    ref = reference.select("case_label", F.col("mean_ms_per_gen").alias("ref_mean_ms_per_gen"))
    usable = F.coalesce(F.col("ref_mean_ms_per_gen") != 0.0, F.lit(False)) & (F.col("best_mean_ms_per_gen") != 0.0)
    ratio = F.try_divide("ref_mean_ms_per_gen", "best_mean_ms_per_gen")
    return best.join(ref, "case_label", "left").withColumn(
        "speedup_vs_ref", F.when(usable, ratio).otherwise(_missing(missing))
    )


def speedup_vs_reference(summary: DataFrame, reference: str, missing=NAN) -> DataFrame:
    """Best configuration of every candidate against the reference simulator."""
    best = best_config(summary.where(F.col("simulator") != reference))
    return attach_reference_speed(best, summary.where(F.col("simulator") == reference), missing)


def attach_baseline(summary: DataFrame, keys: Keys = ("case_label", "alias_builder")) -> DataFrame:
    """Single-thread mean of each key, or the row's own mean where there is none."""
    single = F.max(F.when(F.col("threads") == 1, F.col("mean_ms_per_gen"))).alias("_single")
    return (
        summary.join(summary.groupBy(*keys).agg(single), list(keys))
        .withColumn("baseline_ms_per_gen", F.coalesce("_single", "mean_ms_per_gen"))
        .drop("_single")
    )


def scaling_efficiency(summary: DataFrame, keys: Keys = ("case_label", "alias_builder"), missing=NAN) -> DataFrame:
    """Speedup against one thread, and speedup per thread."""
    based = attach_baseline(summary, keys)
    ratio = F.try_divide("baseline_ms_per_gen", "mean_ms_per_gen")
    speedup = F.when(F.col("mean_ms_per_gen") > 0.0, ratio).otherwise(_missing(missing))
    per_thread = F.try_divide(F.col("speedup_vs_t1"), F.col("threads").cast("double"))
    efficiency = F.when(F.col("threads") > 0, per_thread).otherwise(_missing(missing))
    return based.withColumn("speedup_vs_t1", speedup).withColumn("parallel_efficiency", efficiency)


# ---- phases --------------------------------------------------------------------


def unpivot_profile(profile: DataFrame, keep: Keys, phases: Keys) -> DataFrame:
    """Wide profile rows to (keep, phase, sec)."""
    doubles = profile.select(*keep, *[F.col(p).cast("double").alias(p) for p in phases])
    return doubles.unpivot(list(keep), list(phases), "phase", "sec")


def profile_totals(profile: DataFrame, keys: Keys, total_phase="total") -> DataFrame:
    """Per phase: total, average per generation and percent of the total phase."""
    sums = profile.groupBy(*keys, "phase").agg(
        F.sum("sec").alias("total_sec"), F.avg("sec").alias("avg_sec_per_gen")
    )
    whole = sums.where(F.col("phase") == total_phase).select(*keys, F.col("total_sec").alias("_whole"))
    percent = F.when(F.col("_whole") > 0.0, F.lit(100.0) * F.col("total_sec") / F.col("_whole"))
    joined = sums.join(whole, list(keys), "left") if keys else sums.withColumn(
        "_whole", sums.agg(F.max(F.when(F.col("phase") == total_phase, F.col("total_sec")))).scalar()
    )
    return joined.withColumn("pct_total", F.coalesce(percent, F.lit(0.0))).drop("_whole")


def phase_summary(rows: DataFrame, keys: Keys = ("case_label", "alias_builder", "threads", "phase")) -> DataFrame:
    """Mean and sd of the three measures of each phase."""
    columns = [F.count(F.lit(1)).alias("n_reps")]
    for name in ("total_sec", "avg_sec_per_gen", "pct_total"):
        v = F.col(name).cast("double")
        columns += [F.avg(v).alias(f"mean_{name}"), _sd(v).alias(f"sd_{name}")]
    return rows.groupBy(*keys).agg(*columns)


def phase_group_shares(
    rows: DataFrame, groups: Mapping[str, str] = PHASE_GROUPS, keys: Keys = ("case_label", "alias_builder")
) -> DataFrame:
    """Percent of each display group of phases."""
    group = label(F.col("phase").cast("string"), groups, MINOR_PHASES).alias("phase_group")
    return rows.groupBy(*keys, group).agg(F.sum("mean_pct_total").alias("mean_pct_total"))


def share_guard(shares: DataFrame, keys: Keys = ("case_label", "alias_builder")) -> DataFrame:
    """Groups whose shares do not add up to about 100 percent."""
    totals = shares.groupBy(*keys).agg(F.sum("mean_pct_total").alias("pct_sum"))
    return totals.where((F.col("pct_sum") < 95.0) | (F.col("pct_sum") > 100.5))


# ---- order ---------------------------------------------------------------------


def locus_order(df: DataFrame) -> DataFrame:
    return df.orderBy("chrom", "pos", "mutation_id")


def first_appearance(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order they first occur."""
    return df.groupBy(column).agg(F.min(order).alias("first_at")).orderBy("first_at")


def speedup_ranking(best: DataFrame) -> DataFrame:
    """Cases by their best speedup, highest first; NaN counts as none."""
    ratio = F.when(~F.isnan("speedup_vs_ref"), F.col("speedup_vs_ref"))
    ranked = best.groupBy("case_label").agg(F.max(ratio).alias("best_speedup"))
    return ranked.orderBy(F.desc_nulls_last("best_speedup"), "case_label")


def sample_bad_groups(df: DataFrame, order: Keys, n: int = 5) -> DataFrame:
    """The first ``n`` offending groups, for an error message."""
    return df.orderBy(*order).limit(n)


def summary_order(df: DataFrame, keys: Keys) -> DataFrame:
    return df.orderBy(*keys)
