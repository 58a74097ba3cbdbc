"""Ordered operators against brute force, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from popstat.operators.groups import dense_range
from popstat.operators.intervals import cdf_lookup, interval_join
from popstat.operators.joins import mosaic
from popstat.operators.ordered import previous_value, row_index, running_totals
from popstat.operators.sampling import weighted_pick
from popstat.operators.windows import coverage_violations, cumulative_cdf, cumulative_fixed, emission_deltas


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.randrange(100)) for i in range(3000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k STRING, i BIGINT, x BIGINT")


def test_running_totals_and_numbers(skewed):
    rows, df = skewed
    want, sums, numbers = {}, {}, {}
    for k, i, x in sorted(rows, key=lambda r: r[1]):
        before = sums.get(k, 0)
        sums[k] = before + x
        want[i] = (sums[k], before, numbers.get(k, 0))
        numbers[k] = numbers.get(k, 0) + 1
    summed = running_totals(df, {"s": F.col("x")}, ["i"], ["k"], before={"s": "b"})
    numbered = row_index(summed, "n", ["i"], ["k"]).collect()
    assert {r.i: (r.s, r.b, r.n) for r in numbered} == want


def test_global_order_without_groups(skewed):
    rows, df = skewed
    order = {i: n for n, (x, i) in enumerate(sorted((x, i) for _, i, x in rows))}
    assert {r.i: r.n for r in row_index(df, "n", ["x", "i"]).collect()} == order


def test_previous_value_crosses_slices(skewed):
    rows, df = skewed
    want, last = {}, {}
    for k, i, x in sorted(rows, key=lambda r: r[1]):
        want[i] = last.get(k)
        last[k] = x
    assert {r.i: r.p for r in previous_value(df, "p", "x", ["i"], ["k"]).collect()} == want


def test_running_product(spark):
    df = spark.createDataFrame([(g, 1, 1 - g / 100) for g in range(1, 40)], ["generation", "n_new_fixed", "new_fixed_factor"])
    product, rows = 1.0, {r.generation: r for r in cumulative_fixed(df).collect()}
    for g in range(1, 40):
        product *= 1 - g / 100
        assert rows[g].n_fixed == g and abs(rows[g].fixed_fitness_factor - product) < 1e-12


def test_lookup_takes_the_first_category_that_reaches_the_draw(spark):
    weights = [0.0, 0.1, 0.0, 1e-9, 5.3, 0.2, 0.0]
    cdf = cumulative_cdf(spark.createDataFrame(list(enumerate(weights)), "item BIGINT, weight DOUBLE"), "weight", ["item"])
    bounds = [r.cdf for r in cdf.orderBy("item").collect()]
    total = bounds[-1]
    us = [0.0, 0.1 / total, 0.5, 0.999999, 1.0, 1.5] + [random.Random(4).random() for _ in range(500)]
    draws = spark.createDataFrame(list(enumerate(us)), "d BIGINT, u DOUBLE")
    got = {r.d: r.item for r in cdf_lookup(draws, cdf).collect()}
    want = {d: next((i for i, b in enumerate(bounds) if b >= u * total), len(bounds) - 1) for d, u in enumerate(us)}
    assert got == want


def test_lookup_loses_no_draw_at_float_borders(spark):
    items = spark.range(5000).select(F.col("id").alias("item"), (F.rand(3) / 7 + 0.01).alias("weight"))
    cdf = cumulative_cdf(items, "weight", ["item"])
    total = cdf.agg(F.max("cdf")).first()[0]
    on_border = cdf.select(F.col("item").alias("d"), (F.col("cdf") / F.lit(total)).alias("u"))
    found = cdf_lookup(on_border, cdf)
    assert found.count() == 5000 and found.select("d").distinct().count() == 5000


def test_equal_weights_pick_by_number(spark):
    items = spark.createDataFrame([(i, 2.0) for i in range(4)], "item BIGINT, weight DOUBLE")
    zero = items.withColumn("weight", F.lit(0.0))
    draws = spark.createDataFrame([(0, 0.0), (1, 0.25), (2, 0.7499), (3, 0.99999)], "d BIGINT, u DOUBLE")
    for table in (items, zero):
        assert {r.d: r.item for r in weighted_pick(table, "weight", draws, ["item"]).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_intervals_of_very_unequal_width(spark):
    rng = random.Random(2)
    cuts = sorted({0, 100000, *range(500, 600), *(rng.randrange(100000) for _ in range(20))})
    tiles = [(0, a, b, a) for a, b in zip(cuts, cuts[1:])]
    intervals = spark.createDataFrame(tiles, "chrom INT, start BIGINT, end BIGINT, name BIGINT")
    points = [(c, p) for p in [0, 99999, 100000, 550, 550, *(rng.randrange(100000) for _ in range(300))] for c in (0, 1)]
    df = spark.createDataFrame(points, "chrom INT, pos BIGINT")
    want = sorted((c, p, next(a for _, a, b, _ in tiles if a <= p < b)) for c, p in points if c == 0 and p < 100000)
    got = sorted((r.chrom, r.pos, r.name) for r in interval_join(df, intervals, ["chrom"]).collect())
    assert got == want
    left = interval_join(df, intervals, ["chrom"], how="left")
    assert left.count() == len(points) and left.where("name IS NULL").count() == len(points) - len(want)


def test_emission_deltas(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 12.5), (3, 20.0)], "id BIGINT, t DOUBLE")
    rows = {r.id: (r.dt_sec, r.cumul_sec) for r in emission_deltas(df, "t", ["t", "id"]).collect()}
    assert rows == {1: (0.0, 0.0), 2: (2.5, 2.5), 3: (7.5, 10.0)}


def test_coverage(spark):
    lengths = spark.createDataFrame([(c, 100) for c in range(7)], "chrom INT, length BIGINT")
    good = [(0, 0, 40), (0, 40, 100)]
    bad = [(1, 10, 100), (2, 0, 60), (2, 50, 100), (3, 0, 90), (4, 0, 120), (6, 0, 100), (6, 0, 100)]
    df = spark.createDataFrame(good + bad, "chrom INT, start BIGINT, end BIGINT")
    rows = sorted((r.chrom, r.violation) for r in coverage_violations(df, lengths).collect())
    assert rows == [(1, "not contiguous"), (2, "not contiguous"), (3, "does not reach the end"),
                    (4, "does not reach the end"), (4, "past the end"), (5, "does not reach the end"), (6, "repeated")]


def test_mosaic_rule(spark):
    site = "gamete_id BIGINT, chrom INT, pos BIGINT, mutation_id BIGINT"
    a = spark.createDataFrame([(0, 0, 5, 1), (0, 0, 10, 2), (0, 0, 30, 3), (0, 1, 5, 4)], site)
    b = spark.createDataFrame([(0, 0, 10, 2), (0, 0, 11, 6), (0, 0, 25, 7), (0, 1, 5, 8)], site)
    breaks = spark.createDataFrame([(0, 0, 10), (0, 0, 20), (0, 0, 28), (0, 0, 28)], "gamete_id BIGINT, chrom INT, pos BIGINT")
    starts = spark.createDataFrame([(0, 1, True)], "gamete_id BIGINT, chrom INT, start_on_b BOOLEAN")
    got = sorted((r.chrom, r.mutation_id) for r in mosaic(a, b, breaks, starts).collect())
    # A up to and with 10, B up to 20, then A; the double break at 28 changes nothing; chromosome 1 starts on B
    assert got == [(0, 1), (0, 2), (0, 3), (0, 6), (1, 8)]


def test_mosaic_start_rows_count_each_time_and_null_keys_start_nothing(spark):
    a = spark.createDataFrame([(0, 0, None, 1), (0, 0, 10, 2), (1, 0, 5, 3), (None, 0, 5, 4)], "gamete_id BIGINT, chrom INT, pos BIGINT, mutation_id BIGINT")
    b = a.withColumn("mutation_id", F.col("mutation_id") + 10)
    breaks = spark.createDataFrame([(0, 0, 7)], "gamete_id BIGINT, chrom INT, pos BIGINT")
    starts = spark.createDataFrame([(0, 0, True), (0, 0, True), (0, 0, None), (None, 0, True)], "gamete_id BIGINT, chrom INT, start_on_b BOOLEAN")
    got = sorted(r.mutation_id for r in mosaic(a, b, breaks, starts).collect())
    assert got == [1, 2, 2, 3, 4, 11, 11, 12]


def test_slices_are_as_many_as_their_rows_need(spark, monkeypatch):
    """However many rows there are, a slice holds about ``SLICE_ROWS``; what is joined to them has a row a border at most."""
    from popstat.operators import ordered

    monkeypatch.setattr(ordered, "SLICE_ROWS", 100)
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    joined = []
    inner = ordered._with_slices
    monkeypatch.setattr(ordered, "_with_slices", lambda rows, summary, by: joined.append((rows, summary)) or inner(rows, summary, by))
    totals = running_totals(df, {"t": F.lit(1)}, ["x"], ["g"], before={"t": "b"}).collect()
    assert sorted((r.g, r.x, r.t, r.b) for r in totals) == sorted((x % 3, x, x // 3 + 1, x // 3) for x in range(5000))
    rows, summary = joined[0]
    sizes = [r["count"] for r in rows.groupBy("_slice").count().collect()]
    assert len(sizes) > 40 and max(sizes) < 250
    assert 40 < summary.where("_later").count() < len(sizes)


def test_dense_range_in_blocks(spark):
    df = spark.createDataFrame([(1, 10), (2, 0)], "k BIGINT, n BIGINT")
    rows = sorted((r.k, r.v) for r in dense_range(df, "v", "n", block=4).collect())
    assert rows == [(1, v) for v in range(11)] + [(2, 0)]


def test_null_is_a_group(spark):
    from popstat.operators.ordered import previous_value, running_totals

    df = spark.createDataFrame([(g, i) for g in (None, "a") for i in range(5)], "g string, x long")
    totals = running_totals(df, {"t": F.col("x")}, ["x"], ["g"]).collect()
    assert sorted((r.g is None, r.x, r.t) for r in totals) == sorted((g, i, sum(range(i + 1))) for g in (True, False) for i in range(5))
    before = previous_value(df, "p", "x", ["x"], ["g"]).collect()
    assert sorted((r.g is None, r.x, -1 if r.p is None else r.p) for r in before) == sorted((g, i, i - 1) for g in (True, False) for i in range(5))


def test_widths_of_any_size_meet_few_candidates(spark):
    """20,000 intervals of width 1 beside one of two thousand million: each point meets its own."""
    rows = [(0, i, i + 1, f"n{i}") for i in range(20_000)] + [(0, 20_000, 2_000_000_000, "wide")]
    intervals = spark.createDataFrame(rows, "chrom int, start long, end long, name string")
    points = spark.range(40_000).selectExpr("0 AS chrom", "id AS pos")
    got = interval_join(points, intervals, ["chrom"])
    assert got.count() == 40_000
    assert got.where("(pos < 20000 and name != concat('n', pos)) or (pos >= 20000 and name != 'wide')").count() == 0
    i = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in i and "NestedLoop" not in i


def test_points_outside_stay_in_a_left_join(spark):
    intervals = spark.createDataFrame([(0, 5, 8, "a"), (0, 8, 40, "b"), (1, 0, 1, "c")], "chrom int, start long, end long, name string")
    points = spark.createDataFrame([(0, p) for p in (4, 5, 7, 8, 39, 40)] + [(1, 0), (2, 0), (0, 5)], "chrom int, pos long")
    got = interval_join(points, intervals, ["chrom"], how="left").collect()
    assert sorted((r.chrom, r.pos, r.name or "") for r in got) == [
        (0, 4, ""), (0, 5, "a"), (0, 5, "a"), (0, 7, "a"), (0, 8, "b"), (0, 39, "b"), (0, 40, ""), (1, 0, "c"), (2, 0, ""),
    ]
    assert interval_join(points, intervals.limit(0), ["chrom"], how="left").count() == 9
