"""What a genome without regions, a region type without weights and a statistic without metric give."""

import pytest

from popstat.operators.joins import region_type_mix, unplaced_region_types
from popstat.operators.sampling import synthesize_mutations
from popstat.operators.schedules import coalesce_requests
from popstat.operators.statistics import genome_totals

REGIONS = "chrom int, start long, end long, region_type string"


@pytest.fixture(scope="module")
def model(spark):
    chromosomes = spark.createDataFrame([(0, 100), (1, 50)], "chrom int, length long")
    types = spark.createDataFrame([("exon", 2.5)], "region_type string, mutation_scale double")
    weights = spark.createDataFrame([("exon", "a", 1.0)], "region_type string, type string, weight double")
    kinds = spark.createDataFrame(
        [(t, "constant", 0.1, 0.0, None, None, "additive", 0.5, 0.0, 0.0, 1.0, None) for t in ("a", "b")],
        "type string, sel_kind string, sel_p1 double, sel_p2 double, sel_min double, sel_max double, dom_kind string, "
        "dom_p1 double, dom_p2 double, dom_p3 double, dom_p4 double, "
        "dom_dist struct<kind:string,p1:double,p2:double,min_value:double,max_value:double>",
    )
    return chromosomes, types, weights, kinds


def test_no_regions(spark, model):
    chromosomes, types, weights, kinds = model
    none = spark.createDataFrame([], REGIONS)
    intervals = spark.createDataFrame([], "chrom int, start long, end long, rate_scale double")
    assert {r.mutation_mass for r in genome_totals(chromosomes, none, types, intervals, 1, 1).collect()} == {250.0, 125.0}
    assert {r.mutation_mass for r in genome_totals(chromosomes, none, types.limit(0), intervals, 1, 1).collect()} == {100.0, 50.0}
    mix = region_type_mix(none, types, weights.limit(0), chromosomes, "b").collect()
    assert sorted((r.chrom, r.mutation_mass, r.type, r.probability) for r in mix) == [(0, 250.0, "b", 1.0), (1, 125.0, "b", 1.0)]
    two = types.union(spark.createDataFrame([("intron", 1.0)], types.schema))
    assert unplaced_region_types(none, two).count() == 2 and unplaced_region_types(none, types).count() == 0


@pytest.mark.parametrize("placed", [True, False])
def test_every_id_gets_a_mutation(spark, model, placed):
    chromosomes, types, weights, kinds = model
    types = types.union(spark.createDataFrame([("intron", 1.0)], types.schema)) if placed else types
    rows = [(0, 0, 50, "exon"), (0, 50, 100, "intron")] if placed else []
    made = synthesize_mutations(
        spark.range(100).toDF("mutation_id"), spark.createDataFrame(rows, REGIONS), types, weights, kinds, 7,
        chromosomes=chromosomes, default_type="b",
    ).collect()
    assert sorted(r.mutation_id for r in made) == list(range(100))
    assert {r.type for r in made} == ({"a", "b"} if placed else {"a"})


def test_only_similarity_has_a_metric(spark):
    rows = [(1, "n_seg", "jaccard"), (1, "n_seg", "dice"), (1, "mean_fitness", None), (1, "pairwise_similarity", None), (1, "pairwise_similarity", "dice")]
    df = spark.createDataFrame(rows, "generation long, statistic string, metric string")
    got = {(r.statistic, r.metric) for r in coalesce_requests(df, 5).collect()}
    assert got == {("n_seg", None), ("mean_fitness", None), ("pairwise_similarity", "jaccard"), ("pairwise_similarity", "dice")}
