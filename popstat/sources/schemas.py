"""Column names and types of the text tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The text formats of statistic rows, wide statistics and result tables
STAT_ROW_COLUMNS = (
    "generation", "dt_sec", "cumul_sec", "statistic", "metric",
    "scalar_value", "by_type", "by_chromosome", "unfolded_sfs", "folded_sfs",
)
VECTOR_COLUMNS = ("by_type", "by_chromosome", "unfolded_sfs", "folded_sfs")
COUNT_STATISTICS = ("n_seg", "n_fixed", "genome_words")
WIDE_COLUMNS = {
    "meanFitness": "mean_fitness",
    "geneticLoad": "genetic_load",
    "realizedMaskingBonus": "realized_masking_bonus",
    "exactB": "exact_B",
    "meanPairwiseHaplotypicSimilarity": "pairwise_similarity",
    "numSeg": "n_seg",
    "numFixed": "n_fixed",
    "genomeWords": "genome_words",
    "nucleotideDiversity": "nucleotide_diversity",
    "expectedHeterozygosity": "expected_heterozygosity",
}
PHASES = (
    "reserve_mutation_metadata",
    "build_parent_sampler",
    "distribute_recyclable_ids",
    "parallel_reproduction",
    "reclaim_recyclable_ids",
    "collect_created_mutations",
    "offspring_prefix_sum",
    "offspring_offset_adjust",
    "offspring_copy_and_count",
    "zero_offspring_counts",
    "merge_thread_counts",
    "classify_mutations",
    "collect_finalize_buffers",
    "adjust_fixed_fitness",
    "statistics",
    "swap_populations",
    "total",
)


_TYPES = {"STRING": T.StringType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType()}


def _schema(text: str) -> T.StructType:
    """A schema from "name TYPE, name TYPE"; needs no session, unlike the DDL parser."""
    fields = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


STAT_ROW_TEXT = _schema(", ".join(f"{c} STRING" for c in STAT_ROW_COLUMNS))
WIDE_STATS = _schema("gen BIGINT, dt_sec DOUBLE, cumul_sec DOUBLE, " + ", ".join(f"{c} DOUBLE" for c in WIDE_COLUMNS))

_CASE = "case_label STRING, scenario_name STRING, scenario_description STRING, "
_RUN = "alias_builder STRING, threads BIGINT, replicate BIGINT, seed BIGINT, "
_SPEED = "total_sec DOUBLE, avg_sec_per_gen DOUBLE, ms_per_gen DOUBLE, peak_rss_kb STRING, peak_vmsize_kb STRING"
RESULT_TABLES = {
    "accuracy_scalars": _schema(
        _CASE + "simulator STRING, variant STRING, " + _RUN + "generation BIGINT, metric STRING, value DOUBLE"
    ),
    "accuracy_vectors": _schema(
        _CASE + "simulator STRING, variant STRING, " + _RUN
        + "generation BIGINT, statistic STRING, values_csv STRING"
    ),
    "speed_runs": _schema(_CASE + "simulator STRING, " + _RUN + _SPEED),
    "scaling_runs": _schema(_CASE + _RUN + _SPEED),
    "profile_runs": _schema(_CASE + _RUN + _SPEED),
    "profile_phases": _schema(
        _CASE + _RUN + "phase STRING, total_sec DOUBLE, avg_sec_per_gen DOUBLE, pct_total DOUBLE"
    ),
}

_DIST = "kind STRING, p1 DOUBLE, p2 DOUBLE, min_value DOUBLE, max_value DOUBLE"
SCENARIO = (
    "STRUCT<name STRING, description STRING, N BIGINT, G BIGINT, mu DOUBLE, rho DOUBLE, "
    f"mutation_types ARRAY<STRUCT<name STRING, selection STRUCT<{_DIST}>, "
    f"dominance STRUCT<mode STRING, params ARRAY<DOUBLE>, distribution STRUCT<{_DIST}>>>>, "
    "region_types ARRAY<STRUCT<name STRING, mutation_scale DOUBLE, weights ARRAY<ARRAY<STRING>>>>, "
    "chromosomes ARRAY<STRUCT<name STRING, length BIGINT, "
    "recombination_intervals ARRAY<STRUCT<start BIGINT, `end` BIGINT, rate_scale DOUBLE>>, "
    "regions ARRAY<STRUCT<region_type_name STRING, start BIGINT, `end` BIGINT>>>>>"
)
MANIFEST = f"STRUCT<scenarios MAP<STRING, {SCENARIO}>>"
