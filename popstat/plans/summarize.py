"""From the raw tables of a results folder to its summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popstat.functions.text import parse_int_vector
from popstat.operators.filters import BIOLOGICAL_METRICS
from popstat.operators.results import (
    collect_vector,
    compare_to_reference,
    distribution_distance,
    mean_vector,
    normalized_distribution,
    phase_summary,
    replicate_summary,
    scaling_efficiency,
    speed_summary,
    speedup_vs_reference,
    with_meta,
    worst_error_per_variant,
)
from popstat.sources.readers import read_result_table
from popstat.sources.schemas import RESULT_TABLES
from popstat.sources.writers import write_result_table

VARIANT = ["case_label", "scenario_name", "simulator", "variant"]
RUN = ["case_label", "scenario_name", "scenario_description", "alias_builder", "threads"]


def _own_variant(df: DataFrame, reference: str) -> DataFrame:
    """The reference has one variant, named like itself."""
    variant = F.when(F.col("simulator") == reference, F.lit(reference)).otherwise(F.col("variant"))
    return df.withColumn("variant", variant)


def _vector_distances(groups: DataFrame, shares: DataFrame, reference: str) -> DataFrame:
    """Distance of each candidate's mean vector from the reference's; two empty vectors are 0 apart."""
    on = ["case_label", "statistic"]
    is_ref = F.col("simulator") == reference
    compared = groups.where(~is_ref).select(*on, "variant").distinct()
    compared = compared.join(groups.where(is_ref).select(*on).distinct(), on, "left_semi")
    candidate = shares.where(~is_ref).join(compared, [*on, "variant"], "left_semi")
    beside = compared.join(shares.where(is_ref).select(*on, "pos", "share"), on)
    distance = distribution_distance(candidate, beside, [*on, "variant"])
    return compared.join(distance, [*on, "variant"], "left").na.fill(0.0, ["tvd", "max_bin_abs_diff"])


def summarize_tables(tables: dict[str, DataFrame], reference: str) -> dict[str, DataFrame]:
    """Summary tables of the six raw tables (keys as in ``RESULT_TABLES``)."""
    scalars = _own_variant(tables["accuracy_scalars"], reference)
    scalar_summary = replicate_summary(scalars, [*VARIANT, "metric"], "value")
    scalar_summary = with_meta(scalar_summary, scalars, VARIANT)
    comparison = compare_to_reference(scalar_summary, reference)

    vectors = _own_variant(tables["accuracy_vectors"], reference)
    keys = [*VARIANT, "statistic"]
    groups = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reps"))
    means = mean_vector(vectors.withColumn("_v", parse_int_vector("values_csv")), keys, "_v")
    totals = means.groupBy(*keys).agg(F.sum("mean_value").alias("mean_total"))
    arrays = collect_vector(means, keys, "pos", "mean_value", "mean_values")
    vector_summary = groups.join(arrays, keys, "left").join(totals, keys, "left").select(
        *keys, "n_reps", F.coalesce("mean_values", F.array().cast("array<double>")).alias("mean_values"),
        F.coalesce("mean_total", F.lit(0.0)).alias("mean_total"),
    )
    distances = _vector_distances(groups, normalized_distribution(means, keys, "mean_value"), reference)
    distances = with_meta(distances, vectors.where(F.col("simulator") != reference), ["case_label", "variant"])

    speed = speed_summary(tables["speed_runs"], [*RUN[:3], "simulator", *RUN[3:]])
    scaling = scaling_efficiency(speed_summary(tables["scaling_runs"], RUN))
    return {
        "accuracy_scalar_summary": scalar_summary,
        "accuracy_scalar_comparison": comparison,
        "accuracy_vector_summary": vector_summary,
        "accuracy_vector_comparison": distances,
        "accuracy_variant_overview": worst_error_per_variant(comparison, distances, BIOLOGICAL_METRICS),
        "speed_summary": speed,
        "speed_best_vs_reference": speedup_vs_reference(speed, reference),
        "scaling_summary": scaling,
        "profile_run_summary": speed_summary(tables["profile_runs"], RUN),
        "profile_phase_summary": phase_summary(tables["profile_phases"], [*RUN, "phase"]),
    }


def summarize(spark: SparkSession, folder: str, reference: str, out: str | None = None) -> dict[str, DataFrame]:
    """Read the raw CSV tables below ``folder``, and write the summaries below ``out`` if given."""
    raw = {name: read_result_table(spark, f"{folder}/{name}.csv", name) for name in RESULT_TABLES}
    summaries = summarize_tables(raw, reference)
    if out:
        for name, df in summaries.items():
            flat = [F.array_join(c.cast("array<string>"), ",").alias(f.name) if f.dataType.typeName() == "array" else c
                    for f in df.schema.fields for c in [F.col(f.name)]]
            write_result_table([df.select(*flat)], f"{out}/{name}")
    return summaries
