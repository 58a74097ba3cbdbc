"""Checks of model tables; each gives one row per violation, and none for a valid table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popstat.functions.scalars import SIMILARITY_METRICS
from popstat.operators.schedules import KINDS, violations

# The closed lists of names
STATISTICS = (
    "mean_fitness",
    "genetic_load",
    "realized_masking_bonus",
    "exact_B",
    "pairwise_similarity",
    "n_seg",
    "n_fixed",
    "genome_words",
    "mutation_histogram",
    "site_frequency_spectrum",
    "nucleotide_diversity",
    "expected_heterozygosity",
)
DISTRIBUTIONS = ("constant", "uniform", "normal", "exponential", "gamma", "beta")
DOMINANCE_MODELS = ("additive", "fixed", "distributed", "linear")
NAMES = {
    "statistic": STATISTICS,
    "metric": SIMILARITY_METRICS,
    "distribution": DISTRIBUTIONS,
    "dominance": DOMINANCE_MODELS,
    "schedule": KINDS,
}

POSITIVE = {"scenarios": ("N", "G"), "chromosomes": ("length",), "region_weights": ("weight",)}
NOT_NEGATIVE = {
    "scenarios": ("mu", "rho", "threads"),
    "region_types": ("mutation_scale",),
    "rec_intervals": ("rate_scale",),
}


#: Positions and lengths fit 32 bits without sign, so that a locus packs into 64.
LAST_POSITION = 4294967295
COORDINATES = {
    "chromosomes": ("length",), "regions": ("start", "end"), "rec_intervals": ("start", "end"), "mutations": ("pos",),
}


def check_bounds(table: str, df: DataFrame) -> DataFrame:
    """Numbers of a model table that must be positive, must not be negative, or must fit 32 bits."""
    rules = {f"{c} must be positive": F.col(c) <= 0 for c in POSITIVE.get(table, ()) if c in df.columns}
    rules |= {f"{c} must not be negative": F.col(c) < 0 for c in NOT_NEGATIVE.get(table, ()) if c in df.columns}
    rules |= {
        f"{c} outside 32 bits": (F.col(c) < 0) | (F.col(c) > LAST_POSITION)
        for c in COORDINATES.get(table, ()) if c in df.columns
    }
    return violations(df, rules)


def _distribution_rules(kind: Column, p1: Column, p2: Column, low: Column, high: Column) -> dict[str, Column]:
    return {
        "constant outside its clamp": (kind == "constant") & ((p1 < low) | (p1 > high)),
        "uniform max below min": (kind == "uniform") & (p2 < p1),
        "normal sd negative": (kind == "normal") & (p2 < 0.0),
        "exponential mean negative": (kind == "exponential") & (p1 < 0.0),
        "gamma shape not positive": (kind == "gamma") & (p2 <= 0.0),
        "beta alpha not positive": (kind == "beta") & (p1 <= 0.0),
        "beta beta not positive": (kind == "beta") & (p2 <= 0.0),
        "clamp max below min": high < low,
    }


def check_distributions(mutation_types: DataFrame) -> DataFrame:
    """Parameters of selection and dominance that no draw can be made from."""
    c = F.col
    rules = _distribution_rules(c("sel_kind"), c("sel_p1"), c("sel_p2"), c("sel_min"), c("sel_max"))
    if "dom_kind" in mutation_types.columns:
        rules["linear max_h below min_h"] = (c("dom_kind") == "linear") & (c("dom_p4") < c("dom_p3"))
    if "dom_dist" in mutation_types.columns:
        d = c("dom_dist")
        nested = _distribution_rules(d["kind"], d["p1"], d["p2"], d["min_value"], d["max_value"])
        rules |= {f"dominance: {name}": rule for name, rule in nested.items()}
    return violations(mutation_types, rules)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Names declared more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def empty_sections(parents: DataFrame, children: dict[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Parents without any row in a child table: (key, section)."""
    found = [
        parents.select(*key).join(child.select(*key).distinct(), list(key), "left_anti")
        .withColumn("section", F.lit(name))
        for name, child in children.items()
    ]
    return reduce(DataFrame.unionByName, found)


def unknown_names(df: DataFrame, column: str, universe: str) -> DataFrame:
    """Rows whose name is not in the closed list (one of the keys of ``NAMES``)."""
    return df.where(~F.col(column).isin(*NAMES[universe]))
