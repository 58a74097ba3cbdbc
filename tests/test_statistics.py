"""Statistics on a hand-made population, on two populations and on the given tables."""

import math

import pytest
from pyspark.sql import functions as F

from popstat.functions import mutation_effects
from popstat.operators import statistics as st
from popstat.operators.filters import classify
from popstat.operators.joins import zygosity
from popstat.operators.similarity import mean_pairwise_similarity, pairwise_similarities
from workload.views import Views


@pytest.fixture(scope="module")
def tiny(spark):
    """Two individuals. Mutation 1 is fixed, 2 hom in individual 0, 3 and 4 share a locus, 5 is lost."""
    carriers = [(h, 1) for h in range(4)] + [(0, 2), (1, 2), (0, 3), (2, 4)]
    mutations = [(1, 0, 10, "a", -0.1, 0.5, True), (2, 0, 20, "a", -0.2, 0.5, True),
                 (3, 1, 30, "b", -0.4, 0.25, False), (4, 1, 30, "b", -0.5, 0.1, False), (5, 1, 40, "c", -0.3, 0.1, False)]
    m = spark.createDataFrame(
        mutations, "mutation_id BIGINT, chrom INT, pos BIGINT, type STRING, s DOUBLE, h DOUBLE, additive BOOLEAN"
    )
    m = m.withColumn("_e", mutation_effects("s", "h", "additive")).select(
        "mutation_id", "chrom", "pos", "type", "_e.hom_factor", "_e.het_factor", "_e.masking"
    )
    haplotypes = spark.createDataFrame([(h,) for h in range(4)], "haplotype_id BIGINT")
    return spark.createDataFrame(carriers, "haplotype_id BIGINT, mutation_id BIGINT"), haplotypes, m


def value(df):
    return df.first()[0]


def test_counts_and_status(tiny):
    c, h, m = tiny
    assert value(st.n_seg(c, h)) == 3
    assert value(st.n_fixed(c, h)) == 1
    assert value(st.genome_words(c, h)) == 8
    rows = classify(m, st.copy_counts(c), st.haplotype_totals(h)).collect()
    assert {r.mutation_id: (r.copies, r.status) for r in rows} == {
        1: (4, "fixed"), 2: (2, "segregating"), 3: (1, "segregating"), 4: (1, "segregating"), 5: (0, "lost")}


def test_zygosity(tiny):
    rows = {(r.individual_id, r.mutation_id): r.zygosity for r in zygosity(tiny[0]).collect()}
    assert rows == {(0, 1): "hom", (1, 1): "hom", (0, 2): "hom", (0, 3): "het", (1, 4): "het"}


def test_fitness(tiny):
    c, h, m = tiny
    fitness = {r.individual_id: r.fitness for r in st.individual_fitness(c, h, m).collect()}
    assert math.isclose(fitness[0], 0.8 * 0.9) and math.isclose(fitness[1], 0.95)
    hom = {r.individual_id: r.homozygous_fitness for r in st.homozygous_fitness(c, h, m).collect()}
    assert math.isclose(hom[0], 0.8 * 0.6) and math.isclose(hom[1], 0.5)
    assert math.isclose(value(st.fixed_fitness_factor(c, h, m)), 0.9)
    mean = (0.72 + 0.95) / 2 * 0.9
    assert math.isclose(value(st.mean_fitness(c, h, m)), mean)
    assert math.isclose(value(st.genetic_load(c, h, m)), 1 - mean)
    assert math.isclose(value(st.realized_masking_bonus(c, h, m)), ((0.72 + 0.95) - (0.48 + 0.5)) / 2 * 0.9)


def test_heterozygosity_family(tiny, spark):
    c, h, m = tiny
    chromosomes = spark.createDataFrame([(0, 60), (1, 40)], "chrom INT, length BIGINT")
    het = [0.5, 0.375, 0.375]
    assert math.isclose(value(st.expected_heterozygosity(c, h)), sum(het) / 3)
    assert math.isclose(value(st.nucleotide_diversity(c, h, chromosomes)), sum(het) / 100)
    assert math.isclose(value(st.exact_B(c, h, m)), -0.4 * 0.25 * 0.375 + -0.5 * 0.4 * 0.375)
    assert value(st.nucleotide_diversity(c, h, chromosomes.withColumn("length", F.col("length") * 0))) == 0.0


def test_spectra_and_histograms(tiny, spark):
    c, h, m = tiny
    assert {r.bin: r.n_sites for r in st.sfs_unfolded(c, h).collect()} == {0: 0, 1: 2, 2: 1, 3: 0, 4: 0}
    assert {r.bin: r.n_sites for r in st.sfs_folded(c, h).collect()} == {0: 0, 1: 2, 2: 1}
    types = spark.createDataFrame([("a",), ("b",), ("c",)], ["type"])
    by_type = st.mutation_histogram_by_type(c, h, m, types).collect()
    assert {r.type: r.n_sites for r in by_type} == {"a": 1, "b": 2, "c": 0}
    chromosomes = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "chrom INT, length BIGINT")
    both = st.mutation_histograms(c, h, m, types, chromosomes).collect()
    assert {(r.dimension, r.bin): r.n_sites for r in both} == {
        ("type", "a"): 1, ("type", "b"): 2, ("type", "c"): 0, ("chrom", "0"): 1, ("chrom", "1"): 2, ("chrom", "2"): 0}


def test_groups_without_carriers_have_rows(tiny, spark):
    c, h, m = tiny
    c2 = c.withColumn("snapshot", F.lit(1))
    h2 = h.withColumn("snapshot", F.lit(1)).unionByName(h.withColumn("snapshot", F.lit(2)))
    chromosomes = spark.createDataFrame([(0, 100)], "chrom INT, length BIGINT")
    by = ["snapshot"]
    for df, name, empty in [
        (st.n_seg(c2, h2, by), "n_seg", 0), (st.n_fixed(c2, h2, by), "n_fixed", 0),
        (st.genome_words(c2, h2, by), "genome_words", 0), (st.mean_fitness(c2, h2, m, by), "mean_fitness", 1.0),
        (st.expected_heterozygosity(c2, h2, by), "expected_heterozygosity", 0.0),
        (st.nucleotide_diversity(c2, h2, chromosomes, by), "nucleotide_diversity", 0.0),
        (mean_pairwise_similarity(c2, h2, "dice", by), "mean_similarity", 1.0),
    ]:
        rows = {r.snapshot: r[name] for r in df.collect()}
        assert rows[2] == empty and set(rows) == {1, 2}, name
    spectrum = st.sfs_unfolded(c2, h2, by).collect()
    assert sum(r.n_sites for r in spectrum if r.snapshot == 2) == 0 and len(spectrum) == 10


@pytest.fixture(scope="module", params=[("0.001", 10), ("0.01", 16)])
def given(spark, request):
    """The given tables with haplotypes taken modulo 16, whose values are known."""
    sf, n_hap = request.param
    v = Views(spark, f"/root/testdata/sf{sf}")
    carriers = v.table("lineitem").selectExpr("l_suppkey % 16 AS haplotype_id", "l_partkey AS mutation_id").distinct()
    haplotypes = v.table("supplier").selectExpr("s_suppkey % 16 AS haplotype_id").distinct()
    effects = mutation_effects("s", "h", F.col("h") == 0.5)
    mutations = v.mutations.select("mutation_id", "type", "chrom", effects.alias("e")).selectExpr(
        "mutation_id", "type", "chrom", "e.hom_factor", "e.het_factor", "e.masking"
    )
    return sf, n_hap, carriers, haplotypes, mutations, v


KNOWN = {
    "0.001": dict(n_seg=76, n_fixed=124, words=1905, fitness=0.957128342, bonus=0.002519472, b=-0.000371573, het=0.215,
                  similarity=(0.759666403, 0.86245688, 0.888843572), sfs={8: 19, 9: 57}),
    "0.01": dict(n_seg=1851, n_fixed=149, words=27092, fitness=0.658203977, bonus=0.051512544, b=-0.013544804,
                 het=0.262746488, similarity=(0.712281572, 0.831751104, 0.844315071),
                 sfs={9: 12, 10: 46, 11: 117, 12: 277, 13: 454, 14: 548, 15: 397}),
}


def test_known_values(given):
    sf, n_hap, c, h, m, _ = given
    want = KNOWN[sf]
    assert h.count() == n_hap
    assert value(st.n_seg(c, h)) == want["n_seg"]
    assert value(st.n_fixed(c, h)) == want["n_fixed"]
    assert value(st.genome_words(c, h)) == want["words"]
    f = st.fitness_summary(c, h, m).first()
    assert abs(f.mean_fitness - want["fitness"]) < 1e-8
    assert abs(f.realized_masking_bonus - want["bonus"]) < 1e-8
    family = st.heterozygosity_summary(c, h, m).first()
    assert abs(family.exact_B - want["b"]) < 1e-8
    assert abs(family.expected_heterozygosity - want["het"]) < 1e-8
    assert {r.bin: r.n_sites for r in st.sfs_unfolded(c, h).where("n_sites > 0").collect()} == want["sfs"]
    got = pairwise_similarities(c, h, block=4, chunk=100).first()
    assert all(abs(x - y) < 1e-8 for x, y in zip(got, want["similarity"], strict=True))


def test_statistics_agree_with_each_other(given):
    _, _, c, h, m, v = given
    n = value(st.n_seg(c, h))
    total = lambda df: df.agg(F.sum("n_sites")).first()[0]
    assert total(st.sfs_unfolded(c, h)) == total(st.sfs_folded(c, h)) == n
    assert total(st.mutation_histogram_by_type(c, h, m, v.types)) == n
    assert total(st.mutation_histogram_by_chromosome(c, h, m, v.chromosomes)) == n
    assert value(st.copy_counts(c).agg(F.sum("copies"))) == value(st.genome_words(c, h))
    assert value(st.genome_words(c, h, sites=st.site_counts(c, h))) == value(st.genome_words(c, h))


def test_genome_totals_defaults(spark):
    chromosomes = spark.createDataFrame([(0, 100), (1, 50)], "chrom INT, length BIGINT")
    none = spark.createDataFrame([], "chrom INT, start BIGINT, end BIGINT, region_type STRING, rate_scale DOUBLE")
    kinds = spark.createDataFrame([], "region_type STRING, mutation_scale DOUBLE")
    some = spark.createDataFrame([(0, 0, 100, 0.5)], "chrom INT, start BIGINT, end BIGINT, rate_scale DOUBLE")
    rows = {r.chrom: r for r in st.genome_totals(chromosomes, none, kinds, some, 0.01, 2.0).collect()}
    assert rows[0].recombination_mass == 50 and rows[1].recombination_mass == 50
    assert rows[0].mutation_mass == 100 and rows[0].total_mutation_mass == 150
    assert rows[0].crossover_lambda == 1.0 and math.isclose(rows[1].mutation_lambda, 1.5)


def test_sites_without_a_mutation_row_count_but_for_exact_B(spark):
    carriers = spark.createDataFrame([(0, 1), (1, 1), (0, 2)], "haplotype_id BIGINT, mutation_id BIGINT")
    haplotypes = spark.range(4).withColumnRenamed("id", "haplotype_id")
    mutations = spark.createDataFrame([(1, 2.0)], "mutation_id BIGINT, masking DOUBLE")
    chromosomes = spark.createDataFrame([(0, 100)], "chrom INT, length BIGINT")
    family = st.heterozygosity_summary(carriers, haplotypes, mutations, chromosomes).first()
    assert family.expected_heterozygosity == st.expected_heterozygosity(carriers, haplotypes).first()[0] == 0.4375
    assert family.nucleotide_diversity == st.nucleotide_diversity(carriers, haplotypes, chromosomes).first()[0] == 0.00875
    assert family.exact_B == st.exact_B(carriers, haplotypes, mutations).first()[0] == 1.0
    none = st.heterozygosity_summary(carriers, haplotypes, mutations.limit(0)).first()
    assert none.exact_B == 0 and none.expected_heterozygosity == 0.4375
