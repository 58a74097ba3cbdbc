"""Population statistics over carriers (haplotype x mutation), any number of groups at once.

``carriers`` is (by, haplotype_id, mutation_id) without repeats; ``haplotypes`` is the
universe (by, haplotype_id), which also counts haplotypes that carry nothing;
``mutations`` has one row per mutation id. Every statistic gives one row per group of
the universe, also for a group without carriers. A caller that wants several statistics
makes ``site_counts`` once, writes it, and passes it as ``sites``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popstat.functions.scalars import heterozygosity, individual_of, minor_allele_count
from popstat.operators.filters import fixed, segregating
from popstat.operators.groups import By, attach, dense_range, per_group
from popstat.operators.joins import placed_regions, zero_fill, zygosity
from popstat.session import cut_lineage


def _on(mutations: DataFrame, by: By) -> list[str]:
    return [c for c in by if c in mutations.columns] + ["mutation_id"]


def haplotype_totals(haplotypes: DataFrame, by: By = ()) -> DataFrame:
    """Haplotypes and individuals per group."""
    people = F.count_distinct(individual_of("haplotype_id")).alias("n_individuals")
    return haplotypes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_hap"), people)


def copy_counts(carriers: DataFrame, by: By = ()) -> DataFrame:
    """Copies of each mutation; partial counts are combined before the shuffle."""
    return carriers.groupBy(*by, "mutation_id").agg(F.count(F.lit(1)).alias("copies"))


def site_counts(carriers: DataFrame, haplotypes: DataFrame, by: By = ()) -> DataFrame:
    """Copies of each carried mutation beside the number of haplotypes of its group."""
    totals = haplotypes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_hap"))
    return attach(copy_counts(carriers, by), totals, by)


def _count(sites: DataFrame, haplotypes: DataFrame, by: By, name: str) -> DataFrame:
    counted = sites.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return per_group(haplotypes, counted, by, {name: 0})


def _sites(sites: DataFrame | None, carriers: DataFrame, haplotypes: DataFrame, by: By) -> DataFrame:
    return site_counts(carriers, haplotypes, by) if sites is None else sites


def n_seg(carriers: DataFrame, haplotypes: DataFrame, by: By = (), sites: DataFrame | None = None) -> DataFrame:
    return _count(segregating(_sites(sites, carriers, haplotypes, by)), haplotypes, by, "n_seg")


def n_fixed(carriers: DataFrame, haplotypes: DataFrame, by: By = (), sites: DataFrame | None = None) -> DataFrame:
    return _count(fixed(_sites(sites, carriers, haplotypes, by)), haplotypes, by, "n_fixed")


def genome_words(carriers: DataFrame, haplotypes: DataFrame, by: By = (), sites: DataFrame | None = None) -> DataFrame:
    """Carried copies, those of fixed mutations included."""
    if sites is None:
        return _count(carriers, haplotypes, by, "genome_words")
    copies = sites.groupBy(*by).agg(F.sum("copies").alias("genome_words"))
    return per_group(haplotypes, copies, by, {"genome_words": 0})


# ---- fitness -------------------------------------------------------------------


def _products(carriers: DataFrame, mutations: DataFrame, by: By, sites: DataFrame) -> DataFrame:
    """Fitness products of the individuals that carry a segregating mutation."""
    effects = segregating(sites).join(mutations, _on(mutations, by))
    effects = effects.select(*by, "mutation_id", "hom_factor", "het_factor")
    effect = F.when(F.col("dose") > 1, F.col("hom_factor")).otherwise(F.col("het_factor"))
    return (
        zygosity(carriers, by).select(*by, "individual_id", "mutation_id", "dose")
        .join(effects, [*by, "mutation_id"])
        .groupBy(*by, "individual_id")
        .agg(F.product(effect).alias("fitness"), F.product("hom_factor").alias("homozygous_fitness"))
    )


def _individuals(haplotypes: DataFrame, by: By) -> DataFrame:
    return haplotypes.select(*by, individual_of("haplotype_id").alias("individual_id")).distinct()


def _every_individual(products: DataFrame, haplotypes: DataFrame, by: By, name: str) -> DataFrame:
    everyone = _individuals(haplotypes, by).join(products, [*by, "individual_id"], "left")
    return everyone.select(*by, "individual_id", F.coalesce(name, F.lit(1.0)).alias(name))


def individual_fitness(carriers: DataFrame, haplotypes: DataFrame, mutations: DataFrame, by: By = ()) -> DataFrame:
    """Product over carried segregating mutations: hom factor if on both haplotypes, else het."""
    products = _products(carriers, mutations, by, site_counts(carriers, haplotypes, by))
    return _every_individual(products, haplotypes, by, "fitness")


def homozygous_fitness(carriers: DataFrame, haplotypes: DataFrame, mutations: DataFrame, by: By = ()) -> DataFrame:
    """Product of hom factors, each distinct mutation of the individual once."""
    products = _products(carriers, mutations, by, site_counts(carriers, haplotypes, by))
    return _every_individual(products, haplotypes, by, "homozygous_fitness")


def fixed_fitness_factor(carriers: DataFrame, haplotypes: DataFrame, mutations: DataFrame, by: By = ()) -> DataFrame:
    """Product of hom factors of the fixed mutations."""
    sites = fixed(site_counts(carriers, haplotypes, by)).join(mutations, _on(mutations, by))
    return _factor(sites, haplotypes, by)


def _factor(fixed_sites: DataFrame, haplotypes: DataFrame, by: By) -> DataFrame:
    product = fixed_sites.groupBy(*by).agg(F.product("hom_factor").alias("fixed_fitness_factor"))
    return per_group(haplotypes, product, by, {"fixed_fitness_factor": 1.0})


def fitness_summary(
    carriers: DataFrame, haplotypes: DataFrame, mutations: DataFrame, by: By = (), sites: DataFrame | None = None
) -> DataFrame:
    """mean_fitness, genetic_load and realized_masking_bonus of each group in one pass.

    Individuals without a segregating mutation have fitness 1 and are added by number. Sites
    are counted once and written.
    """
    if sites is None:
        sites = cut_lineage(site_counts(carriers, haplotypes, by))
    products = _products(carriers, mutations, by, sites)
    sums = products.groupBy(*by).agg(
        F.sum("fitness").alias("_w"), F.sum("homozygous_fitness").alias("_hom"),
        F.count(F.lit(1)).alias("_carrying"),
    )
    sums = per_group(haplotypes, sums, by, {"_w": 0.0, "_hom": 0.0, "_carrying": 0})
    factor = _factor(fixed(sites).join(mutations, _on(mutations, by)), haplotypes, by)
    whole = attach(attach(sums, factor, by), haplotype_totals(haplotypes, by), by)
    idle = "(n_individuals - _carrying)"
    mean, mean_hom = (f"({total} + {idle}) / n_individuals" for total in ("_w", "_hom"))
    return whole.selectExpr(
        *by,
        f"{mean} * fixed_fitness_factor AS mean_fitness",
        f"1 - {mean} * fixed_fitness_factor AS genetic_load",
        f"({mean} - {mean_hom}) * fixed_fitness_factor AS realized_masking_bonus",
    )


def mean_fitness(carriers: DataFrame, haplotypes: DataFrame, mutations: DataFrame, by: By = ()) -> DataFrame:
    return fitness_summary(carriers, haplotypes, mutations, by).select(*by, "mean_fitness")


def genetic_load(carriers: DataFrame, haplotypes: DataFrame, mutations: DataFrame, by: By = ()) -> DataFrame:
    return fitness_summary(carriers, haplotypes, mutations, by).select(*by, "genetic_load")


def realized_masking_bonus(
    carriers: DataFrame, haplotypes: DataFrame, mutations: DataFrame, by: By = ()
) -> DataFrame:
    return fitness_summary(carriers, haplotypes, mutations, by).select(*by, "realized_masking_bonus")


# ---- heterozygosity ------------------------------------------------------------


def genome_length(chromosomes: DataFrame) -> Column:
    """Total length of the genome as a scalar."""
    return chromosomes.agg(F.sum("length").cast("double")).scalar()


def heterozygosity_summary(
    carriers: DataFrame,
    haplotypes: DataFrame,
    mutations: DataFrame | None = None,
    chromosomes: DataFrame | None = None,
    by: By = (),
    sites: DataFrame | None = None,
) -> DataFrame:
    """expected_heterozygosity, with ``chromosomes`` nucleotide_diversity, with ``mutations`` exact_B.

    A site without a row in ``mutations`` has no masking and adds nothing to exact_B alone.
    """
    sites = segregating(_sites(sites, carriers, haplotypes, by))
    h = heterozygosity("copies", "n_hap")
    aggs = [F.avg(h).alias("expected_heterozygosity")]
    if chromosomes is not None:
        length = genome_length(chromosomes)
        diversity = F.coalesce(F.try_divide(F.sum(h), length), F.lit(0.0))
        aggs.append(diversity.alias("nucleotide_diversity"))
    if mutations is not None:
        sites = sites.join(mutations.select(*_on(mutations, by), "masking"), _on(mutations, by), "left")
        aggs.append(F.sum(F.col("masking") * h).alias("exact_B"))
    defaults = {"expected_heterozygosity": 0.0, "nucleotide_diversity": 0.0, "exact_B": 0.0}
    return per_group(haplotypes, sites.groupBy(*by).agg(*aggs), by, defaults)


def exact_B(carriers: DataFrame, haplotypes: DataFrame, mutations: DataFrame, by: By = ()) -> DataFrame:
    return heterozygosity_summary(carriers, haplotypes, mutations, by=by).select(*by, "exact_B")


def nucleotide_diversity(carriers: DataFrame, haplotypes: DataFrame, chromosomes: DataFrame, by: By = ()) -> DataFrame:
    return heterozygosity_summary(carriers, haplotypes, chromosomes=chromosomes, by=by).select(
        *by, "nucleotide_diversity"
    )


def expected_heterozygosity(carriers: DataFrame, haplotypes: DataFrame, by: By = ()) -> DataFrame:
    return heterozygosity_summary(carriers, haplotypes, by=by)


# ---- histograms and spectra ----------------------------------------------------


def _groups_with(haplotypes: DataFrame, values: DataFrame, name: str, by: By) -> DataFrame:
    """Every group of the universe with every declared value (a short list of types or chromosomes)."""
    if not by:
        return values.select(name).distinct()
    declared = values.agg(F.collect_set(name)).scalar()
    return haplotypes.select(*by).distinct().withColumn(name, F.explode(declared))


def _histogram(carriers, haplotypes, mutations, declared, name: str, by: By) -> DataFrame:
    sites = segregating(site_counts(carriers, haplotypes, by))
    sites = sites.join(mutations.select(*_on(mutations, by), name), _on(mutations, by))
    counted = sites.groupBy(*by, name).agg(F.count(F.lit(1)).alias("n_sites"))
    return zero_fill(counted, _groups_with(haplotypes, declared, name, by), [*by, name], ["n_sites"])


def mutation_histogram_by_type(carriers, haplotypes, mutations, types: DataFrame, by: By = ()) -> DataFrame:
    """Segregating sites of every declared type."""
    return _histogram(carriers, haplotypes, mutations, types, "type", by)


def mutation_histogram_by_chromosome(carriers, haplotypes, mutations, chromosomes, by: By = ()) -> DataFrame:
    """Segregating sites of every declared chromosome."""
    return _histogram(carriers, haplotypes, mutations, chromosomes, "chrom", by)


def mutation_histograms(
    carriers, haplotypes, mutations, types, chromosomes, by: By = (), sites: DataFrame | None = None
) -> DataFrame:
    """Both histograms from one pass over the sites: (by, dimension, bin, n_sites)."""
    sites = segregating(_sites(sites, carriers, haplotypes, by))
    sites = sites.join(mutations.select(*_on(mutations, by), "type", "chrom"), _on(mutations, by))
    by = list(by)
    columns = [*by, "type", "chrom"]
    counted = sites.groupingSets([[*by, "type"], [*by, "chrom"]], *columns).agg(
        F.count(F.lit(1)).alias("n_sites"), F.grouping("type").alias("_no_type")
    )
    is_type = F.col("_no_type") == 0
    counted = counted.select(
        *by, F.when(is_type, "type").otherwise("chrom").alias("dimension"),
        F.when(is_type, F.col("type")).otherwise(F.col("chrom").cast("string")).alias("bin"), "n_sites",
    )
    universe = _groups_with(haplotypes, types, "type", by).select(
        *by, F.lit("type").alias("dimension"), F.col("type").alias("bin")
    ).unionByName(
        _groups_with(haplotypes, chromosomes, "chrom", by).select(
            *by, F.lit("chrom").alias("dimension"), F.col("chrom").cast("string").alias("bin")
        )
    )
    return zero_fill(counted, universe, [*by, "dimension", "bin"], ["n_sites"])


def _spectrum(carriers, haplotypes, by: By, sites, bin_of: Column, last_bin: Column) -> DataFrame:
    sites = segregating(_sites(sites, carriers, haplotypes, by))
    counted = sites.groupBy(*by, bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n_sites"))
    totals = haplotypes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_hap"))
    bins = dense_range(totals.withColumn("_last", last_bin), "bin", "_last").select(*by, "bin")
    return zero_fill(counted, bins, [*by, "bin"], ["n_sites"])


def sfs_unfolded(carriers: DataFrame, haplotypes: DataFrame, by: By = (), sites: DataFrame | None = None) -> DataFrame:
    """Sites per copy count, bins 0..n_hap."""
    return _spectrum(carriers, haplotypes, by, sites, F.col("copies"), F.col("n_hap"))


def sfs_folded(carriers: DataFrame, haplotypes: DataFrame, by: By = (), sites: DataFrame | None = None) -> DataFrame:
    """Sites per minor allele count, bins 0..n_hap/2."""
    half = F.shiftright("n_hap", 1)
    return _spectrum(carriers, haplotypes, by, sites, minor_allele_count("copies", "n_hap"), half)


# ---- genome totals -------------------------------------------------------------


def genome_totals(
    chromosomes: DataFrame, regions: DataFrame, region_types: DataFrame, rec_intervals: DataFrame, mu, rho
) -> DataFrame:
    """Per chromosome: length, masses and crossover rate, beside the totals of the genome.

    A chromosome without recombination intervals has the flat scale 1; a genome without any
    placed region mutates everywhere at the scale of its only region type, or at scale 1.
    """
    width = (F.col("end") - F.col("start")).cast("double")
    mutable = placed_regions(regions, region_types, chromosomes).groupBy("chrom").agg(
        F.sum(F.col("mutation_scale") * width).alias("_mutable")
    )
    crossing = rec_intervals.groupBy("chrom").agg(F.sum(F.col("rate_scale") * width).alias("_crossing"))
    per_chrom = (
        chromosomes.select("chrom", "length").join(mutable, "chrom", "left").join(crossing, "chrom", "left")
        .select(
            "chrom", "length",
            F.coalesce("_crossing", F.col("length").cast("double")).alias("recombination_mass"),
            F.coalesce("_mutable", F.lit(0.0)).alias("mutation_mass"),
        )
    )
    totals = per_chrom.agg(
        F.sum("length").alias("total_length"),
        F.sum("recombination_mass").alias("total_recombination_mass"),
        F.sum("mutation_mass").alias("total_mutation_mass"),
    )
    share = F.coalesce(F.try_divide("recombination_mass", "total_recombination_mass"), F.lit(0.0))
    return attach(per_chrom, totals, ()).select(
        "*",
        (F.lit(mu).cast("double") * F.col("total_mutation_mass")).alias("mutation_lambda"),
        (F.lit(rho).cast("double") * share).alias("crossover_lambda"),
    )
