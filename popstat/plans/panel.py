"""All requested statistics of many generations in the long form of statistic rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popstat.functions.scalars import SIMILARITY_METRICS
from popstat.operators.checks import STATISTICS
from popstat.operators.results import collect_vector, union_results
from popstat.operators.schedules import metric_of
from popstat.operators.similarity import pairwise_similarities
from popstat.operators.statistics import (
    fitness_summary,
    genome_words,
    heterozygosity_summary,
    mutation_histograms,
    n_fixed,
    n_seg,
    sfs_folded,
    sfs_unfolded,
    site_counts,
)
from popstat.session import cut_lineage

GENERATION = ["generation"]
FITNESS = ("mean_fitness", "genetic_load", "realized_masking_bonus")
DIVERSITY = ("exact_B", "nucleotide_diversity", "expected_heterozygosity")
PANEL = (
    "generation BIGINT, statistic STRING, metric STRING, scalar_value DOUBLE, by_type ARRAY<BIGINT>, "
    "by_chromosome ARRAY<BIGINT>, unfolded_sfs ARRAY<BIGINT>, folded_sfs ARRAY<BIGINT>"
)
FROM_SITES = (
    *DIVERSITY, "n_seg", "n_fixed", "genome_words", "mutation_histogram", "site_frequency_spectrum",
)


def _scalars(stats: DataFrame, names: Sequence[str], metric: str | None = None) -> DataFrame:
    doubles = stats.select("generation", *[F.col(n).cast("double").alias(n) for n in names])
    long = doubles.unpivot(GENERATION, list(names), "statistic", "scalar_value")
    if metric == "each":
        return long.select("generation", F.lit("pairwise_similarity").alias("statistic"),
                           F.col("statistic").alias("metric"), "scalar_value")
    return long


def _vectors(statistic: str, **bins: DataFrame) -> DataFrame:
    """Two histograms of one statistic as ordered arrays, one row per generation."""
    first, second = (collect_vector(df, GENERATION, "bin", "n_sites", name) for name, df in bins.items())
    return first.join(second, GENERATION).withColumn("statistic", F.lit(statistic))


def stat_panel(
    carriers: DataFrame,
    haplotypes: DataFrame,
    mutations: DataFrame,
    types: DataFrame,
    chromosomes: DataFrame,
    requests: DataFrame,
) -> DataFrame:
    """Statistic rows (generation, statistic, metric, scalar_value and four vectors) of the requests.

    ``carriers`` and ``haplotypes`` hold one population per generation. ``requests`` is
    (generation, statistic, metric) from ``expand_schedules``; the driver reads which of
    the twelve statistics occur, and plans only those. Carriers and haplotypes of the
    generations asked for are written once, as are the copies per site, from which all but
    fitness and similarity follow. A family of statistics is computed for the generations
    that ask for one of it. Snapshots are
    taken to keep fixed mutations, so that n_fixed counts from the start. Repeated requests
    give one row, and ``metric`` is NULL but for similarity.
    """
    metric = metric_of("statistic", "metric").alias("metric")
    requests = cut_lineage(requests.select(*GENERATION, "statistic", metric).distinct())

    known = requests.where(F.col("statistic").isin(*STATISTICS))
    wanted = {row.statistic for row in known.select("statistic").distinct().collect()}

    empty = carriers.sparkSession.createDataFrame([], PANEL)
    if not wanted:
        return empty

    def only(names: Sequence[str], *tables: DataFrame) -> list[DataFrame]:
        at = requests.where(F.col("statistic").isin(*names)).select("generation").distinct()
        return [table.join(at, GENERATION, "left_semi") for table in tables]

    written = [cut_lineage(df) for df in only(STATISTICS, carriers, haplotypes)]
    written.append(cut_lineage(site_counts(*written, GENERATION)))
    parts = []
    if wanted & set(FITNESS):
        c, h, sites = only(FITNESS, *written)
        parts.append(_scalars(fitness_summary(c, h, mutations, GENERATION, sites=sites), FITNESS))
    if wanted & set(FROM_SITES):
        c, h, sites = only(FROM_SITES, *written)
        shared = {"by": GENERATION, "sites": sites}
        if wanted & set(DIVERSITY):
            parts.append(_scalars(heterozygosity_summary(c, h, mutations, chromosomes, **shared), DIVERSITY))
        for name, count in (("n_seg", n_seg), ("n_fixed", n_fixed), ("genome_words", genome_words)):
            if name in wanted:
                parts.append(_scalars(count(c, h, **shared), [name]))
        if "mutation_histogram" in wanted:
            bins = mutation_histograms(c, h, mutations, types, chromosomes, **shared)
            chroms = bins.where("dimension = 'chrom'").withColumn("bin", F.col("bin").cast("int"))
            parts.append(_vectors("mutation_histogram", by_type=bins.where("dimension = 'type'"), by_chromosome=chroms))
        if "site_frequency_spectrum" in wanted:
            folded, unfolded = sfs_folded(c, h, **shared), sfs_unfolded(c, h, **shared)
            parts.append(_vectors("site_frequency_spectrum", unfolded_sfs=unfolded, folded_sfs=folded))
    rows = [union_results(parts).join(requests, [*GENERATION, "statistic"])] if parts else []
    if "pairwise_similarity" in wanted:
        c, h, sites = only(["pairwise_similarity"], *written)
        similar = pairwise_similarities(c, h, GENERATION, sites=sites)
        paired = _scalars(similar, SIMILARITY_METRICS, "each")
        rows.append(paired.join(requests, [*GENERATION, "statistic", "metric"]))
    return union_results([empty, *rows])
