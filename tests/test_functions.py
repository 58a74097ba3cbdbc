import math

from pyspark.sql import functions as F

from popstat import functions as fn

NAN = float("nan")


def one(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_locus_packs_and_unpacks(spark):
    df = spark.createDataFrame([(3, 4294967295), (0, 0), (2147483646, 7)], "chrom INT, pos BIGINT")
    got = df.select(fn.pack_locus("chrom", "pos").alias("l"), "chrom", "pos")
    for r in got.select("*", fn.locus_chrom("l").alias("c"), fn.locus_pos("l").alias("p")).collect():
        assert (r.c, r.p) == (r.chrom, r.pos) and r.l == r.chrom * 2**32 + r.pos


def test_clamp_bounds_and_nan(spark):
    assert one(spark, fn.clamp("x", 0, 1), x=-3.0) == 0
    assert one(spark, fn.clamp("x", 0, 1), x=3.0) == 1
    assert one(spark, fn.clamp("x", None, 1), x=-3.0) == -3
    assert math.isnan(one(spark, fn.clamp("x", 0, 1), x=NAN))


def test_effects_floor_selection_and_additive_masking(spark):
    e = one(spark, fn.mutation_effects("s", "h", F.lit(False)), s=-1.0, h=0.1)
    assert e.s == -0.999999999 and e.hom_factor > 0
    assert math.isclose(e.masking, -0.999999999 * 0.4)
    assert one(spark, fn.mutation_effects("s", "h", F.lit(True)), s=-0.2, h=0.1).masking == 0.0


def test_dominance_models(spark):
    df = spark.createDataFrame(
        [("additive", None), ("fixed", None), ("linear", None), ("distributed", 0.7)], "kind STRING, draw DOUBLE"
    )
    h = fn.dominance_coefficient("kind", 0.2, -10.0, 0.0, 0.4, -0.05, "draw")
    assert [r.h for r in df.select(h.alias("h")).collect()] == [0.5, 0.2, 0.4, 0.7]


def test_recovered_dominance_falls_back_only_for_neutral_draws(spark):
    df = spark.createDataFrame([("distributed", 0.0, 1.0), ("distributed", -0.1, 0.97), ("fixed", 0.0, 1.0)],
                               "kind STRING, s DOUBLE, het DOUBLE")
    r = fn.recover_dominance("kind", 0.25, None, None, None, "s", "het", 0.6)
    rows = [x.r for x in df.select(r.alias("r")).collect()]
    assert [x.used_fallback for x in rows] == [True, False, False]
    assert rows[0].h == 0.6 and math.isclose(rows[1].h, 0.3) and rows[2].h == 0.25


def test_expected_draw(spark):
    rows = [("constant", 0.3, 0.0, 0.3), ("uniform", 0.0, 1.0, 0.5), ("beta", 2.0, 6.0, 0.25), ("beta", 0.0, 0.0, 0.5),
            ("gamma", -0.2, 0.5, -0.2), ("normal", 4.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "kind STRING, p1 DOUBLE, p2 DOUBLE, want DOUBLE")
    for r in df.select("want", fn.expected_draw("kind", "p1", "p2", None, 2.0).alias("got")).collect():
        assert math.isclose(r.got, r.want)


def test_similarity_of_empty_sets(spark):
    for metric in fn.SIMILARITY_METRICS:
        assert one(spark, fn.set_similarity("a", "b", "i", metric), a=0, b=0, i=0) == 1.0
        assert one(spark, fn.set_similarity("a", "b", "i", metric), a=0, b=4, i=0) == 0.0
    assert one(spark, fn.set_similarity("a", "b", "i", "jaccard"), a=3, b=2, i=1) == 0.25
    assert one(spark, fn.set_similarity("a", "b", "i", "dice"), a=3, b=2, i=1) == 0.4
    assert one(spark, fn.set_similarity("a", "b", "i", "overlap"), a=3, b=2, i=1) == 0.5


def test_vectors(spark):
    assert one(spark, fn.parse_int_vector("t"), t="  ") == []
    assert one(spark, fn.parse_int_vector("t"), t="1,,2, 3") == [1, 2, 3]
    assert one(spark, fn.format_int_vector(F.array(F.lit(4), F.lit(5)))) == "4,5"


def test_error_bands_and_rel_diff(spark):
    df = spark.createDataFrame([(0.009, 0), (0.01, 1), (0.05, 2), (0.1, 3), (None, 0)], "x DOUBLE, band INT")
    assert all(r.band == r.got for r in df.select("band", fn.error_band("x").alias("got")).collect())
    assert one(spark, fn.rel_diff("a", "b"), a=3.0, b=-2.0) == 2.5
    assert one(spark, fn.rel_diff("a", "b"), a=3.0, b=1e-13) > 2.9


def test_labels(spark):
    assert one(spark, fn.label("v", {"pop_10k": "Ten thousand"}), v="pop_10k") == "Ten thousand"
    assert one(spark, fn.label("v", {"pop_10k": "Ten thousand"}), v="some_case") == "some case"
    assert one(spark, fn.label("v", fn.BUILDER_LABELS, "same"), v="x_y") == "x_y"
    assert one(spark, fn.label("v", fn.PHASE_GROUPS, fn.MINOR_PHASES), v="x_y") == "Minor phases"


def test_numbers_as_text(spark):
    assert one(spark, fn.export_number("x"), x=1e-16) == "0"
    assert one(spark, fn.export_number("x"), x=-2.0) == "-2"
    assert float(one(spark, fn.export_number("x"), x=-1e-5)) == -1e-5
    assert one(spark, fn.format_scalar("x"), x=0.5) == "0.5000000000"
    assert one(spark, fn.kb_to_gib("t"), t="n/a") is None
    assert one(spark, fn.kb_to_gib("t"), t="1048576") == 1.0
    assert one(spark, fn.finite("x"), x=float("inf")) is False
