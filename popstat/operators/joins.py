"""Joins that annotate mutations, carriers and gametes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popstat.functions.scalars import individual_of
from popstat.operators.groups import By
from popstat.operators.intervals import interval_join
from popstat.operators.ordered import running_totals


def annotate_region(mutations: DataFrame, regions: DataFrame, how: str = "inner") -> DataFrame:
    """Region columns of the region [start, end) each mutation lies in."""
    return interval_join(mutations, regions, ["chrom"], how=how)


def annotate_rec_interval(mutations: DataFrame, rec_intervals: DataFrame, how: str = "inner") -> DataFrame:
    """Rate scale of the recombination interval each mutation lies in."""
    return interval_join(mutations, rec_intervals, ["chrom"], how=how)


def attach_mutations(carriers: DataFrame, mutations: DataFrame, by: By = ()) -> DataFrame:
    """Carrier rows with the attributes of their mutation.

    A plain equi-join: a mutation carried by nearly all haplotypes is a skewed key
    on the left side only, which adaptive execution splits.
    """
    shared = [c for c in by if c in mutations.columns]
    return carriers.join(mutations, [*shared, "mutation_id"])


def attach_types(mutations: DataFrame, mutation_types: DataFrame) -> DataFrame:
    return mutations.join(mutation_types, "type")


def zygosity(carriers: DataFrame, by: By = ()) -> DataFrame:
    """Per individual and mutation: ``dose`` 2 if both haplotypes carry it, else 1."""
    individual = individual_of("haplotype_id").alias("individual_id")
    return (
        carriers.groupBy(*by, individual, "mutation_id")
        .agg(F.count(F.lit(1)).alias("dose"))
        .withColumn("zygosity", F.when(F.col("dose") > 1, "hom").otherwise("het"))
    )


def distinct_carried(carriers: DataFrame, by: By = ()) -> DataFrame:
    """Set union of the mutations on the two haplotypes of each individual."""
    return carriers.select(*by, individual_of("haplotype_id").alias("individual_id"), "mutation_id").distinct()


def mosaic(hap_a: DataFrame, hap_b: DataFrame, breakpoints: DataFrame, start_on_b: DataFrame) -> DataFrame:
    """Mutations a gamete takes from haplotype A or B.

    ``hap_a`` and ``hap_b`` hold (gamete_id, chrom, pos, mutation_id). A gamete
    starts on B where ``start_on_b`` (gamete_id, chrom, start_on_b) says so, and
    changes sides at each breakpoint below the position of the mutation; a
    repeated breakpoint counts each time. Breakpoints, mutations and starts are counted
    in one ordered pass, not by pairing them. A mutation comes once for each start row of
    its gamete and chromosome that gives it.
    """
    site, nothing = ["gamete_id", "chrom", "pos"], F.lit(0).cast("long")
    side = lambda df, on_b: df.select(*site, "mutation_id", nothing.alias("_breaks"), F.lit(on_b).alias("from_b"))
    kinds = {c: hap_a.schema[c].dataType for c in (*site, "mutation_id")}
    breaks = breakpoints.groupBy(*site).agg(F.count(F.lit(1)).alias("_breaks")).select(
        *site, F.lit(None).cast("long").alias("mutation_id"), "_breaks", F.lit(False).alias("from_b")
    )
    on_b = F.count_if(F.coalesce("start_on_b", F.lit(False)))
    starts = start_on_b.dropna(subset=["gamete_id", "chrom"]).groupBy("gamete_id", "chrom").agg(
        on_b.alias("_on_b"), (F.count(F.lit(1)) - on_b).alias("_on_a")
    )
    first = starts.select(  # before all else of its gamete and chromosome: without a position, and -1 breaks
        *[F.col(c).cast(kinds[c]).alias(c) for c in ("gamete_id", "chrom")],
        *[F.lit(None).cast(kinds[c]).alias(c) for c in ("pos", "mutation_id")],
        F.lit(-1).cast("long").alias("_breaks"), F.lit(False).alias("from_b"), "_on_b", "_on_a",
    )
    events = side(hap_a, False).unionByName(side(hap_b, True)).unionByName(breaks)
    counted = running_totals(
        events.unionByName(first, allowMissingColumns=True),
        {"_crossed": F.greatest("_breaks", nothing), "_all_on_b": F.coalesce("_on_b", nothing), "_all_on_a": F.coalesce("_on_a", nothing)},
        ["pos", "_breaks", "mutation_id", "from_b"], ["gamete_id", "chrom"],
    )
    unstarted = F.col("_all_on_a") + F.col("_all_on_b") == 0
    given_on_a = F.when(unstarted, F.lit(1)).otherwise(F.col("_all_on_a"))
    times = F.when(F.col("from_b") == (F.col("_crossed") % 2 == 1), given_on_a).otherwise(F.col("_all_on_b"))
    kept = counted.where(F.col("_breaks") == 0).where(times > 0)
    return kept.select(*site, "mutation_id", "from_b", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).drop("col")


def merge_sources(inherited: DataFrame, new: DataFrame) -> DataFrame:
    """Inherited and new mutations of each haplotype, in locus order."""
    return inherited.unionByName(new).orderBy("haplotype_id", "chrom", "pos", "mutation_id")


def unresolved(refs: DataFrame, declared: DataFrame, key: Sequence[str]) -> DataFrame:
    """Names that are used but not declared."""
    return refs.join(declared.select(*key).distinct(), list(key), "left_anti")


def placed_regions(regions: DataFrame, region_types: DataFrame, chromosomes: DataFrame | None = None) -> DataFrame:
    """chrom, start, end, region_type and mutation_scale of each placed region.

    A genome without placed regions has one per chromosome of ``chromosomes``, of the only
    declared region type, or of scale 1 if none is declared. More than one declared type
    without placements is an error of the model, see ``unplaced_region_types``.
    """
    scales = region_types.select("region_type", F.col("mutation_scale").cast("double").alias("mutation_scale"))
    placed = regions.select("chrom", "start", "end", "region_type").join(scales, "region_type")
    placed = placed.select("chrom", "start", "end", "region_type", "mutation_scale")
    if chromosomes is None:
        return placed
    nowhere = (regions.agg(F.count(F.lit(1))).scalar() == 0)
    name, scale = (scales.agg(F.min(c)).scalar() for c in ("region_type", "mutation_scale"))
    whole = chromosomes.where(nowhere).select(
        "chrom", F.lit(0).cast("long").alias("start"), F.col("length").cast("long").alias("end"),
        F.coalesce(name, F.lit(DEFAULT_REGION_TYPE)).alias("region_type"), F.coalesce(scale, F.lit(1.0)).alias("mutation_scale"),
    )
    return placed.unionByName(whole)


DEFAULT_REGION_TYPE = "default"


def unplaced_region_types(regions: DataFrame, region_types: DataFrame) -> DataFrame:
    """Declared region types of a genome without placed regions, if there is more than one."""
    nowhere = regions.agg(F.count(F.lit(1))).scalar() == 0
    several = region_types.agg(F.count(F.lit(1))).scalar() > 1
    return region_types.where(nowhere & several).select("region_type")


def type_shares(placed: DataFrame, region_weights: DataFrame, default_type: str | None) -> DataFrame:
    """``region_type``, ``type`` and ``weight`` of every placed region type; without weights the first declared type."""
    own = region_weights.select("region_type", "type", F.col("weight").cast("double").alias("weight"))
    kinds = placed.select("region_type").distinct()
    if default_type is None:
        return kinds.join(own, "region_type")
    filled = [F.coalesce("type", F.lit(default_type)).alias("type"), F.coalesce("weight", F.lit(1.0)).alias("weight")]
    return kinds.join(own, "region_type", "left").select("region_type", *filled)


def region_type_mix(
    regions: DataFrame, region_types: DataFrame, region_weights: DataFrame,
    chromosomes: DataFrame | None = None, default_type: str | None = None,
) -> DataFrame:
    """Per placed region and mutation type: mutation mass of the region and share of the type.

    With ``default_type``, the first declared mutation type, a region type without weights
    has that type alone; with ``chromosomes`` a genome without regions gets the default ones.
    """
    placed = placed_regions(regions, region_types, chromosomes)
    weights = type_shares(placed, region_weights, default_type)
    totals = weights.groupBy("region_type").agg(F.sum("weight").alias("_total"))
    shares = weights.join(totals, "region_type").select(
        "region_type", "type", (F.col("weight") / F.col("_total")).alias("probability")
    )
    width = (F.col("end") - F.col("start")).cast("double")
    return (
        placed.withColumn("mutation_mass", F.col("mutation_scale") * width)
        .join(shares, "region_type")
        .select("chrom", "start", "end", "region_type", "mutation_mass", "type", "probability")
    )


def zero_fill(df: DataFrame, universe: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per row of ``universe``; values absent from ``df`` are 0."""
    joined = universe.join(df, list(on), "left")
    for name in values:
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return joined
