import math

import pytest
from pyspark.sql import functions as F

from popstat.operators import sampling as sp


def moments(df, c="x"):
    return df.agg(F.avg(c), F.stddev(c), F.min(c), F.max(c), F.count(c)).first()


# kind, p1, p2, low, high, mean, sd
DISTS = [
    ("constant", 0.3, 0.0, 0.3, 0.0),
    ("uniform", -1.0, 3.0, 1.0, 4 / math.sqrt(12)),
    ("normal", 2.0, 0.5, 2.0, 0.5),
    ("exponential", 0.7, 0.0, 0.7, 0.7),
    ("gamma", 0.4, 0.3, 0.4, 0.4 / math.sqrt(0.3)),
    ("gamma", -2.0, 4.0, -2.0, 1.0),
    ("gamma", 0.0, 4.0, 0.0, 0.0),
    ("beta", 2.0, 6.0, 0.25, math.sqrt(12 / (64 * 9))),
    ("beta", 0.5, 0.5, 0.5, math.sqrt(0.125)),
]


@pytest.mark.parametrize(("kind", "p1", "p2", "mean", "sd"), DISTS)
def test_moments(spark, kind, p1, p2, mean, sd):
    n = 40000
    df = spark.range(n).select("id", F.lit(kind).alias("k"), F.lit(p1).alias("p1"), F.lit(p2).alias("p2"))
    got = moments(df.select(sp.draw("id", "k", "p1", "p2", None, None, seed=1).alias("x")))
    assert abs(got[0] - mean) <= 5 * sd / math.sqrt(n) + 1e-12
    assert abs(got[1] - sd) <= 0.05 * sd + 1e-12 and got[4] == n


def test_clamp_after_drawing(spark):
    df = spark.range(2000).select("id", F.lit("normal").alias("k"), F.lit(0.0).alias("p1"), F.lit(1.0).alias("p2"))
    got = moments(df.select(sp.draw("id", "k", "p1", "p2", -0.5, 0.25, seed=1).alias("x")))
    assert (got[2], got[3]) == (-0.5, 0.25)


@pytest.mark.parametrize("rate", [0.0, 0.2, 7.5, 1500.0])
def test_poisson(spark, rate):
    n = 20000
    df = spark.range(n).withColumn("rate", F.lit(rate))
    got = moments(sp.poisson_counts(df, "rate", "id", seed=3), "n_events")
    assert abs(got[0] - rate) <= 5 * math.sqrt(rate / n) + 1e-12
    assert rate == 0.0 or abs(got[1] ** 2 / rate - 1) < 0.06


def test_draws_do_not_depend_on_partitions(spark):
    def made(parts):
        df = spark.range(500).repartition(parts).select(
            "id", F.when(F.col("id") % 2 == 0, "gamma").otherwise("beta").alias("k"), F.lit(1.5).alias("p1"),
            F.lit(0.7).alias("p2"))
        return sorted(df.select("id", sp.draw("id", "k", "p1", "p2", None, None, seed=9).alias("x")).collect())

    assert made(1) == made(7)


def test_uniforms(spark):
    got = moments(spark.range(40000).select(sp.uniform("id", 5).alias("x")))
    assert 0 <= got[2] and got[3] < 1 and abs(got[0] - 0.5) < 0.01


def test_expanded_counts_and_seeds(spark):
    df = spark.createDataFrame([("a", 0), ("b", 10)], "c STRING, replicates BIGINT")
    seeds = [r.seed for r in sp.seed_list(df).orderBy("replicate").collect()]
    assert seeds == [101, 202, 303, 404, 505, 606, 707, 808, 909, 1010]


def test_run_grid(spark):
    cases = spark.createDataFrame([("a", 2), ("b", 1)], "case_label STRING, replicates BIGINT")
    own = spark.createDataFrame([("b", [4, 8])], "case_label STRING, threads ARRAY<BIGINT>")
    rows = sp.expand_run_grid(cases, ["x", "y"], [1], own).collect()
    got = sorted((r.case_label, r.alias_builder, r.threads, r.seed) for r in rows)
    assert got == [("a", "x", 1, 101), ("a", "x", 1, 202), ("a", "y", 1, 101), ("a", "y", 1, 202),
                   ("b", "x", 4, 101), ("b", "x", 8, 101), ("b", "y", 4, 101), ("b", "y", 8, 101)]


def test_synthetic_mutations(spark):
    regions = spark.createDataFrame([(0, 0, 100, "e"), (0, 100, 400, "i"), (1, 0, 50, "e")],
                                    "chrom INT, start BIGINT, end BIGINT, region_type STRING")
    kinds = spark.createDataFrame([("e", 4.0), ("i", 1.0)], "region_type STRING, mutation_scale DOUBLE")
    weights = spark.createDataFrame([("e", "del", 3.0), ("e", "neu", 1.0), ("i", "neu", 1.0)],
                                    "region_type STRING, type STRING, weight DOUBLE")
    dist = "dom_dist STRUCT<kind STRING, p1 DOUBLE, p2 DOUBLE, min_value DOUBLE, max_value DOUBLE>"
    types = spark.createDataFrame(
        [("del", "gamma", -0.05, 0.3, -0.9, 0.0, "distributed", None, None, None, None, ("uniform", 0.1, 0.2, 0.0, 1.0)),
         ("neu", "constant", 0.0, 0.0, 0.0, 0.0, "additive", None, None, None, None, None)],
        "type STRING, sel_kind STRING, sel_p1 DOUBLE, sel_p2 DOUBLE, sel_min DOUBLE, sel_max DOUBLE, dom_kind STRING, "
        "dom_p1 DOUBLE, dom_p2 DOUBLE, dom_p3 DOUBLE, dom_p4 DOUBLE, " + dist)
    ids = spark.range(9000).withColumnRenamed("id", "mutation_id")
    made = sp.synthesize_mutations(ids, regions, kinds, weights, types, seed=2).cache()
    assert made.count() == 9000 and made.select("mutation_id").distinct().count() == 9000
    share = made.where("chrom = 0 AND pos < 100").count() / 9000
    assert abs(share - 400 / 900) < 0.03
    assert made.where("type = 'del' AND (s > 0 OR s < -0.9 OR h < 0.1 OR h > 0.2)").count() == 0
    assert made.where("type = 'del' AND chrom = 0 AND pos >= 100").count() == 0
    assert made.where("type = 'neu' AND (masking <> 0 OR hom_factor <> 1)").count() == 0
    assert made.where("pos < 0 OR pos >= 400 OR (chrom = 1 AND pos >= 50)").count() == 0
