import pytest
from pyspark.sql import functions as F

from popstat.operators import checks as ck
from popstat.operators import schedules as sc
from popstat.operators.filters import at_max, prefer_variant, report_points

SCHEMA = "stat STRING, metric STRING, kind STRING, step BIGINT, start BIGINT, end BIGINT, generations ARRAY<BIGINT>"


def table(spark, *rows):
    return spark.createDataFrame([("n_seg", "jaccard", *r) for r in rows], SCHEMA)


GOLDEN = [
    (8, ("up_to", None, None, 3, None), [1, 2, 3]),
    (8, ("at_after", None, 6, None, None), [6, 7, 8]),
    (8, ("every_up_to", 3, None, 8, None), [3, 6]),
    (8, ("every_at_after", 2, 5, None, None), [5, 7]),
    (8, ("range", None, 2, 4, None), [2, 3, 4]),
    (8, ("every_range", 2, 2, 7, None), [2, 4, 6]),
    (5, ("every", 2, None, None, None), [2, 4]),
    (5, ("at", None, None, None, [3, 5, 3]), [3, 5]),
    (3, ("always", None, None, None, None), [1, 2, 3]),
    (5, ("every", 9, None, None, None), []),
]


@pytest.mark.parametrize(("last", "row", "want"), GOLDEN)
def test_expansion(spark, last, row, want):
    rows = sc.expand_schedules(table(spark, row), last).collect()
    assert sorted(r.generation for r in rows) == want


def test_rules_match_expansion(spark):
    g = spark.range(1, 9).withColumnRenamed("id", "generation")
    for rule, want in [
        (sc.schedule_every(3), [3, 6]), (sc.schedule_at([2, 7, 2]), [2, 7]), (sc.schedule_up_to(2), [1, 2]),
        (sc.schedule_at_after(7), [7, 8]), (sc.schedule_every_up_to(2, 5), [2, 4]),
        (sc.schedule_every_at_after(3, 2), [2, 5, 8]), (sc.schedule_range(4, 5), [4, 5]),
        (sc.schedule_every_range(2, 3, 7), [3, 5, 7]), (sc.schedule_always(), list(range(1, 9))),
    ]:
        assert sorted(r.generation for r in sc.scheduled(g, rule).collect()) == want


def test_overlapping_schedules_ask_once(spark):
    both = table(spark, ("every", 2, None, None, None), ("range", None, 3, 6, None))
    assert sorted(r.generation for r in sc.expand_schedules(both, 8).collect()) == [2, 3, 4, 5, 6, 8]


def test_check_schedules(spark):
    bad = table(spark, ("every", 0, None, None, None), ("up_to", None, None, 9, None), ("range", None, 5, 2, None),
                ("at", None, None, None, []), ("at", None, None, None, [0, 4]), ("at_after", None, 0, None, None))
    names = sorted(r.violation for r in sc.check_schedules(bad, 8).collect())
    assert names == sorted(["step not positive", "end outside [1, G]", "end before start", "no generation",
                            "generation outside [1, G]", "start outside [1, G]"])
    good = table(spark, *[row for last, row, want in GOLDEN if last == 8])
    assert sc.check_schedules(good, 8).count() == 0


def test_never_fires(spark):
    rows = table(spark, ("every", 9, None, None, None), ("every_up_to", 4, None, 3, None), ("every", 8, None, None, None))
    assert sorted(r.step for r in sc.never_fires(rows, 8).collect()) == [4, 9]


def test_report_points_keep_the_last(spark):
    g = spark.range(1, 12).withColumnRenamed("id", "generation")
    assert [r.generation for r in g.where(report_points("generation", 5, 11)).collect()] == [5, 10, 11]


def test_distribution_rules(spark):
    rows = [("constant", 0.5, 0.0, 0.0, 0.4), ("uniform", 1.0, 0.0, None, None), ("normal", 0.0, -1.0, None, None),
            ("exponential", -0.01, 0.0, None, None), ("gamma", 0.1, 0.0, None, None), ("beta", 0.0, 1.0, None, None),
            ("beta", 1.0, 0.0, None, None), ("normal", 0.0, 1.0, 1.0, 0.0), ("gamma", -0.1, 0.3, None, None)]
    df = spark.createDataFrame(rows, "sel_kind STRING, sel_p1 DOUBLE, sel_p2 DOUBLE, sel_min DOUBLE, sel_max DOUBLE")
    found = ck.check_distributions(df)
    assert found.count() == 8 and found.where("sel_kind = 'gamma'").count() == 1


def test_bounds_names_duplicates_and_sections(spark):
    s = spark.createDataFrame([("a", 0, 1, -1.0, 0.0), ("b", 5, 5, 0.0, 0.0), ("b", 1, 1, 0.1, 0.1)],
                              "scenario STRING, N BIGINT, G BIGINT, mu DOUBLE, rho DOUBLE")
    assert sorted(r.violation for r in ck.check_bounds("scenarios", s).collect()) == [
        "N must be positive", "mu must not be negative"]
    assert [r.n for r in ck.duplicate_keys(s, ["scenario"]).collect()] == [2]
    child = spark.createDataFrame([("b",)], ["scenario"])
    assert [(r.scenario, r.section) for r in ck.empty_sections(s, {"types": child}, ["scenario"]).collect()] == [("a", "types")]
    names = spark.createDataFrame([("jaccard",), ("cosine",)], ["metric"])
    assert [r.metric for r in ck.unknown_names(names, "metric", "metric").collect()] == ["cosine"]


def test_selections_on_result_tables(spark):
    df = spark.createDataFrame([("ref", 1, "total"), ("a@T1", 1, "x"), ("b@T8", 8, "total"), ("b@T8", 8, "x")],
                               "variant STRING, threads BIGINT, phase STRING")
    assert {r.variant for r in prefer_variant(df, "b@", "ref").collect()} == {"b@T8"}
    assert {r.variant for r in prefer_variant(df, "zzz", "ref").collect()} == {"a@T1", "b@T8"}
    assert [(r.threads, r.phase) for r in at_max(df).collect()] == [(8, "x")]
    assert df.where(F.col("threads") == 8).count() == 2
