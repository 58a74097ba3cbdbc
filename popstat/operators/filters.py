"""Row filters: mutation status, report points, and selections on result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popstat.operators.groups import By, attach

# The metrics compared between simulators
BIOLOGICAL_METRICS = (
    "mean_fitness",
    "genetic_load",
    "realized_masking_bonus",
    "exact_B",
    "n_seg",
    "n_fixed",
    "nucleotide_diversity",
    "expected_heterozygosity",
)


def status(copies, n_hap) -> Column:
    copies, n_hap = F.col(copies), F.col(n_hap)
    return F.when(copies == 0, "lost").when(copies == n_hap, "fixed").otherwise("segregating")


def segregating(counts: DataFrame) -> DataFrame:
    """Sites carried by some but not all haplotypes; needs ``copies`` and ``n_hap``."""
    return counts.where((F.col("copies") > 0) & (F.col("copies") < F.col("n_hap")))


def fixed(counts: DataFrame) -> DataFrame:
    return counts.where((F.col("copies") > 0) & (F.col("copies") == F.col("n_hap")))


def classify(mutations: DataFrame, counts: DataFrame, totals: DataFrame, by: By = ()) -> DataFrame:
    """Status of every known mutation in every group; a mutation without carriers is lost.

    ``mutations`` may list the known mutations per group. If it does not have the
    group columns, every mutation is known in every group of ``totals``, the table
    of haplotype totals with one row per group.
    """
    by = list(by)
    if by and not set(by) <= set(mutations.columns):
        groups = totals.agg(F.array_sort(F.collect_list(F.struct(*by)))).scalar()
        mutations = mutations.withColumn("_g", F.explode(groups)).select("*", "_g.*").drop("_g")
    known = attach(mutations, totals.select(*by, "n_hap"), by)
    joined = known.join(counts.select(*by, "mutation_id", "copies"), [*by, "mutation_id"], "left")
    return joined.withColumn("copies", F.coalesce("copies", F.lit(0).cast("long"))).withColumn(
        "status", status("copies", "n_hap")
    )


def report_points(generation, interval: int, last) -> Column:
    """Every ``interval``-th generation, and always the last one."""
    g = F.col(generation)
    last = last if isinstance(last, Column) else F.lit(last)
    return (g % F.lit(interval) == 0) | (g == last)


def biological_metrics(df: DataFrame, metric: str = "metric", names=BIOLOGICAL_METRICS) -> DataFrame:
    return df.where(F.col(metric).isin(*names))


def prefer_variant(df: DataFrame, pattern: str, reference: str, variant: str = "variant") -> DataFrame:
    """Rows whose variant contains ``pattern``; if none does, all but the reference's."""
    match = F.col(variant).contains(pattern)
    matched = df.agg(F.coalesce(F.bool_or(match), F.lit(False))).scalar()
    return df.where(match | (~matched & (F.col(variant) != reference)))


def at_max(df: DataFrame, column: str = "threads", label: str = "phase", excluding: str = "total") -> DataFrame:
    """Rows at the largest value of ``column``, without the rows labelled ``excluding``."""
    top = df.agg(F.max(column)).scalar()
    return df.where((F.col(column) == top) & (F.col(label) != excluding))
