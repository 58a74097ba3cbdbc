import math
import statistics

import pytest
from pyspark.sql import functions as F

from popstat.operators import results as rs
from popstat.plans.summarize import summarize
from popstat.sources.writers import write_result_table


def test_replicates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 5.0)], "k STRING, v DOUBLE")
    rows = {r.k: r for r in rs.replicate_summary(df, ["k"], "v").collect()}
    assert math.isclose(rows["a"].sd, statistics.stdev([1, 2, 4])) and rows["a"].n_reps == 3
    assert (rows["b"].mean, rows["b"].sd) == (5.0, 0.0)


def test_optional_values(spark):
    df = spark.createDataFrame([("a", ""), ("a", "n/a"), ("b", "3"), ("b", ""), ("c", "1"), ("c", "2")], ["k", "v"])
    rows = {r.k: r for r in rs.optional_summary(df, ["k"], "v").collect()}
    assert math.isnan(rows["a"].mean) and math.isnan(rows["a"].sd)
    assert (rows["b"].mean, rows["b"].sd) == (3.0, 0.0) and rows["c"].mean == 1.5


def test_mean_vector_pads_with_zero(spark):
    df = spark.createDataFrame([("a", [1, 2, 3]), ("a", [3]), ("b", [])], "k STRING, v ARRAY<BIGINT>")
    rows = {(r.k, r.pos): r.mean_value for r in rs.mean_vector(df, ["k"], "v").collect()}
    assert rows == {("a", 0): 2.0, ("a", 1): 1.0, ("a", 2): 1.5}


def test_distances(spark):
    a = spark.createDataFrame([("x", 0, 3.0), ("x", 1, 1.0), ("z", 0, 0.0)], "k STRING, pos INT, v DOUBLE")
    b = spark.createDataFrame([("x", 0, 1.0), ("x", 2, 1.0), ("z", 0, 0.0)], "k STRING, pos INT, v DOUBLE")
    left, right = (rs.normalized_distribution(d, ["k"], "v") for d in (a, b))
    rows = {r.k: r for r in rs.distribution_distance(left, right, ["k"]).collect()}
    assert math.isclose(rows["x"].tvd, 0.5 * (0.25 + 0.25 + 0.5)) and math.isclose(rows["x"].max_bin_abs_diff, 0.5)
    assert rows["z"].tvd == 0.0


SUMMARY = "case_label STRING, simulator STRING, alias_builder STRING, threads BIGINT, mean_ms_per_gen DOUBLE, sd_ms_per_gen DOUBLE"


@pytest.fixture(scope="module")
def speed(spark):
    rows = [("c1", "cand", "p", 4, 2.0, 0.1), ("c1", "cand", "p", 1, 2.0, 0.2), ("c1", "cand", "p", 8, 3.0, 0.3),
            ("c1", "ref", "", 1, 10.0, 0.0), ("c2", "cand", "p", 2, 5.0, 0.0), ("c3", "cand", "p", 2, 5.0, 0.0),
            ("c3", "ref", "", 1, 0.0, 0.0)]
    return spark.createDataFrame(rows, SUMMARY)


def test_best_configuration_and_speedup(speed):
    rows = {r.case_label: r for r in rs.speedup_vs_reference(speed, "ref").collect()}
    assert (rows["c1"].best_threads, rows["c1"].best_sd_ms_per_gen) == (1, 0.2)  # the tie keeps the smaller count
    assert rows["c1"].speedup_vs_ref == 5.0
    assert math.isnan(rows["c2"].speedup_vs_ref) and rows["c2"].ref_mean_ms_per_gen is None
    assert math.isnan(rows["c3"].speedup_vs_ref)


def test_ranking_puts_missing_last(speed):
    ranked = rs.speedup_ranking(rs.speedup_vs_reference(speed, "ref")).collect()
    assert [r.case_label for r in ranked] == ["c1", "c2", "c3"]


def test_scaling(speed):
    cand = speed.where("simulator = 'cand'")
    rows = {(r.case_label, r.threads): r for r in rs.scaling_efficiency(cand).collect()}
    assert rows["c1", 1].parallel_efficiency == 1.0 and rows["c1", 4].parallel_efficiency == 0.25
    assert rows["c2", 2].speedup_vs_t1 == 1.0 and rows["c2", 2].parallel_efficiency == 0.5
    zero = rs.scaling_efficiency(cand.withColumn("mean_ms_per_gen", F.lit(0.0))).first()
    assert math.isnan(zero.speedup_vs_t1)


def test_profile_totals_without_time(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0), (1, "total", 0.0)], "g INT, phase STRING, sec DOUBLE")
    rows = {r.phase: r for r in rs.profile_totals(df, []).collect()}
    assert rows["a"].total_sec == 6.0 and rows["a"].avg_sec_per_gen == 3.0 and rows["a"].pct_total == 0.0
    with_total = df.unionByName(spark.createDataFrame([(3, "total", 12.0)], df.schema))
    assert {r.phase: r.pct_total for r in rs.profile_totals(with_total, []).collect()}["a"] == 50.0


def test_share_guard(spark):
    df = spark.createDataFrame([("a", "p", 60.0), ("a", "p", 40.0), ("b", "p", 94.0), ("c", "p", 101.0)],
                               "case_label STRING, alias_builder STRING, mean_pct_total DOUBLE")
    bad = rs.share_guard(df)
    assert [r.case_label for r in rs.sample_bad_groups(bad, ["case_label"]).collect()] == ["b", "c"]


def test_last_wins_and_first_appearance(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("m", 1, "only")], "k STRING, t INT, v STRING")
    assert {r.k: r.v for r in rs.last_wins(df, ["k"], ["t"]).collect()} == {"k": "new", "m": "only"}
    assert [r.v for r in rs.first_appearance(df.withColumn("n", F.col("t")), "v", "n").collect()][-1] == "new"


def test_variant_maxima(spark):
    comparison = spark.createDataFrame([("a", "n_seg", 0.2), ("a", "other", 0.9), ("b", "n_seg", 0.1)],
                                       "variant STRING, metric STRING, rel_diff DOUBLE")
    distances = spark.createDataFrame([("b", 0.3), ("c", 0.4)], "variant STRING, tvd DOUBLE")
    rows = {r.variant: (r.max_scalar_rel_diff, r.max_vector_tvd)
            for r in rs.worst_error_per_variant(comparison, distances).collect()}
    assert rows == {"a": (0.2, 0.0), "b": (0.1, 0.3), "c": (0.0, 0.4)}


def test_summaries_of_a_folder(spark, tmp_path):
    case = ("c", "s", "d")
    scalars = [(*case, "ref", "", "", 1, r, r, 5, "n_seg", 10.0) for r in (1, 2)]
    scalars += [(*case, "cand", "p@T2", "p", 2, r, r, 5, "n_seg", 11.0 + r) for r in (1, 2)]
    vectors = [(*case, "ref", "", "", 1, 1, 1, 5, "sfs", "0,3,1"), (*case, "cand", "p@T2", "p", 2, 1, 1, 5, "sfs", "0,1,1,2"),
               (*case, "cand", "p@T2", "p", 2, 1, 1, 5, "empty", ""), (*case, "ref", "", "", 1, 1, 1, 5, "empty", "")]
    from popstat.sources.schemas import RESULT_TABLES

    for name, rows in (("accuracy_scalars", scalars), ("accuracy_vectors", vectors)):
        write_result_table([spark.createDataFrame(rows, RESULT_TABLES[name])], f"{tmp_path}/{name}.csv")
    out = summarize(spark, str(tmp_path), "ref", str(tmp_path / "out"))
    row = out["accuracy_scalar_comparison"].first()
    assert row.ref_mean == 10.0 and row["mean"] == 12.5 and math.isclose(row.rel_diff, 0.25)
    vectors = {r.statistic: r for r in out["accuracy_vector_comparison"].collect()}
    assert math.isclose(vectors["sfs"].tvd, 0.5) and vectors["empty"].tvd == 0.0
    summary = {(r.statistic, r.simulator): r for r in out["accuracy_vector_summary"].collect()}
    assert summary["sfs", "cand"].mean_values == [0.0, 1.0, 1.0, 2.0] and summary["empty", "ref"].mean_total == 0.0
    overview = out["accuracy_variant_overview"].first()
    assert math.isclose(overview.max_scalar_rel_diff, 0.25) and math.isclose(overview.max_vector_tvd, 0.5)
    assert out["scaling_summary"].count() == 0
    written = spark.read.csv(str(tmp_path / "out" / "accuracy_vector_summary"), header=True)
    assert written.count() == 4
