import json

from pyspark.sql import types as T

from popstat.functions import mutation_effects
from popstat.operators.schedules import expand_schedules
from popstat.plans.panel import stat_panel
from popstat.sources import readers as rd
from popstat.sources import writers as wr
from popstat.sources.schemas import STAT_ROW_COLUMNS, WIDE_COLUMNS

PANEL = ("generation BIGINT, dt_sec DOUBLE, cumul_sec DOUBLE, statistic STRING, metric STRING, scalar_value DOUBLE, "
         "by_type ARRAY<BIGINT>, by_chromosome ARRAY<BIGINT>, unfolded_sfs ARRAY<BIGINT>, folded_sfs ARRAY<BIGINT>")


def test_stat_rows_round_trip(spark, tmp_path):
    rows = [(1, 0.5, 0.5, "mean_fitness", "jaccard", 0.98765, None, None, None, None),
            (1, 0.5, 0.5, "n_seg", "jaccard", 12.0, None, None, None, None),
            (2, 0.25, 0.75, "site_frequency_spectrum", "jaccard", None, None, None, [0, 3, 0], [0, 3]),
            (2, 0.25, 0.75, "mutation_histogram", "jaccard", None, [1, 2], [3], None, None)]
    df = spark.createDataFrame(rows, PANEL)
    wr.write_stat_rows(df, str(tmp_path / "rows"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "rows").glob("part-*")))
    assert "\t".join(STAT_ROW_COLUMNS) in text and "0.9876500000" in text and "\t12\t" in text and "0,3,0" in text
    back = rd.read_stat_rows(spark, str(tmp_path / "rows"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_wide_file(spark, tmp_path):
    head = "gen,dt_sec,cumul_sec," + ",".join(WIDE_COLUMNS)
    (tmp_path / "w.csv").write_text(head + "\n5,0.1,0.2,0.9,0.1,0,0,0.5,7,1,20,0.01,0.3\n")
    rows = {r.statistic: r.value for r in rd.read_wide_stats(spark, str(tmp_path / "w.csv")).collect()}
    assert len(rows) == 10 and rows["n_seg"] == 7.0 and rows["pairwise_similarity"] == 0.5


def test_logs(spark, tmp_path):
    folder = tmp_path / "raw" / "speed" / "pop_10k"
    folder.mkdir(parents=True)
    good = ("Total wall-clock: 1.500000 sec\nAvg sec/gen: 0.015000\nTotal wall-clock: 9.0 sec\n"
            "  build_parent_sampler       total=  0.500000  avg/gen=  0.005000  pct= 33.33%  \nnoise total=1\n")
    (folder / "tool_parallel_psa_plus_T32_seed101.stderr").write_text(good)
    (folder / "other_seed202.stderr").write_text("nothing here\n")
    lines = rd.read_lines(spark, str(folder))
    wall = {r.seed: r for r in rd.with_run_context(rd.extract_wall_metrics(lines)).collect()}
    assert (wall[101].total_sec, wall[101].avg_sec_per_gen, wall[101].complete) == (1.5, 0.015, True)
    assert (wall[101].alias_builder, wall[101].threads, wall[101].case_label) == ("parallel_psa_plus", 32, "pop_10k")
    assert (wall[202].complete, wall[202].threads, wall[202].alias_builder, wall[202].simulator) == (False, 1, "", "other")
    phases = rd.extract_phase_profile(lines).collect()
    assert [(r.phase, r.total_sec, r.pct_total) for r in phases] == [("build_parent_sampler", 0.5, 33.33)]


def test_tagged_lines(spark):
    lines = ["scalar\tn_seg\t12", " vector\tsfs\t0,1,2 ", "vector\tnone\t", "note\ta\tb", "scalar\tonly", "", "vector\tx\t1\t"]
    rows = rd.read_tagged_metrics(spark.createDataFrame([(x,) for x in lines], ["value"])).collect()
    assert [(r.kind, r.name, r.scalar_value, r.vector_value) for r in rows] == [
        ("scalar", "n_seg", 12.0, None), ("vector", "sfs", None, [0, 1, 2]), ("vector", "x", None, [1])]


def test_missing_and_empty_result_tables(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    (tmp_path / "empty.csv").write_text("")
    for name in ("absent.csv", "empty.csv"):
        df = rd.read_result_table(spark, str(tmp_path / name), schema)
        assert df.schema == schema and df.count() == 0
    one = spark.createDataFrame([(1,)], "a BIGINT")
    two = spark.createDataFrame([('say "hi", there',)], "b STRING")
    wr.write_result_table([one, two], str(tmp_path / "t"))
    back = rd.read_result_table(spark, str(tmp_path / "t"), schema).collect()
    assert sorted((r.a or 0, r.b or "") for r in back) == [(0, 'say "hi", there'), (1, "")]


def test_manifest(spark, tmp_path):
    dist = {"kind": "gamma", "p1": -0.01, "p2": 0.3, "min_value": -1.0, "max_value": 0.0}
    scenario = {
        "name": "s1", "description": "d", "N": 40, "G": 12, "mu": 1e-7, "rho": 0.5,
        "mutation_types": [{"name": "del", "selection": dist, "dominance": {"mode": "fixed", "params": [0.25]}},
                           {"name": "neu", "selection": dist, "dominance": {"mode": "additive", "params": []}}],
        "region_types": [{"name": "exon", "mutation_scale": 2.0, "weights": [["del", 0.75], ["neu", 0.25]]}],
        "chromosomes": [{"name": "chr1", "length": 100, "recombination_intervals": [{"start": 0, "end": 100, "rate_scale": 1.0}],
                         "regions": [{"region_type_name": "exon", "start": 0, "end": 100}]},
                        {"name": "chr2", "length": 50, "recombination_intervals": [], "regions": []}],
    }
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"generated_at": "x", "scenarios": {"s1": scenario, "s2": scenario}}, indent=2))
    tables = rd.read_model_manifest(spark, str(path))
    assert {n: df.count() for n, df in tables.items()} == {
        "scenarios": 2, "mutation_types": 4, "region_types": 2, "region_weights": 4, "chromosomes": 4, "regions": 2,
        "rec_intervals": 2}
    kinds = {r.type: r for r in tables["mutation_types"].where("scenario = 's1'").collect()}
    assert kinds["del"].dom_p1 == 0.25 and kinds["neu"].dom_p1 is None and kinds["del"].sel_p2 == 0.3
    assert {r.weight for r in tables["region_weights"].collect()} == {0.75, 0.25}


MUTATIONS = ("mutation_id BIGINT, chrom INT, pos BIGINT, type STRING, type_index INT, dom_kind STRING, s DOUBLE, h DOUBLE, "
             "origin_generation BIGINT")


def test_population_text(spark, tmp_path):
    mutations = spark.createDataFrame(
        [(7, 0, 5, "a", 0, "additive", -0.5, 0.5, 1), (3, 0, 5, "b", 1, "linear", -0.25, 0.75, 2),
         (9, 1, 2, "b", 1, "linear", -0.125, 0.75, 3), (8, 1, 1, "a", 0, "additive", -0.5, 0.5, 1)], MUTATIONS)
    carriers = [(0, 7), (0, 3), (1, 3), (2, 9)] + [(h, 8) for h in range(4)]
    lines = wr.population_lines(
        spark.createDataFrame(carriers, "haplotype_id BIGINT, mutation_id BIGINT"), mutations,
        spark.range(4).withColumnRenamed("id", "haplotype_id"),
        spark.createDataFrame([(0, 10), (1, 20)], "chrom INT, length BIGINT"), 2, 9, piece=1)
    wr.export_population(lines, str(tmp_path / "pop"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "pop").glob("part-*"))).splitlines()
    assert text == [
        "#OUT: 9 9 A", "Version: 8", "Flags:", "Populations:", "p1 2 H", "Individuals:", "p1:i0 H", "p1:i1 H",
        'Chromosome: 0 A 1 9 "1"', "Mutations:", "0 3 m3 5 -0.25 0.75 p1 2 2", "1 7 m1 5 -0.5 0.5 p1 1 1",
        "Haplosomes:", "p1:i0 0 1", "p1:i0 0", "p1:i1", "p1:i1",
        'Chromosome: 1 A 2 19 "2"', "Mutations:", "0 9 m3 2 -0.125 0.75 p1 3 1",
        "Haplosomes:", "p1:i0", "p1:i0", "p1:i1 0", "p1:i1"]


def test_effects_are_read_from_the_factors(spark):
    rows = [("additive", 0.9, 0.95, None), ("fixed", 0.9, 0.5, 0.3), ("linear", 0.5, 0.9, 0.4), ("distributed", 0.5, 0.9, None), ("distributed", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "dom_kind string, hom_factor double, het_factor double, dom_p1 double").selectExpr(
        "*", "-0.2D AS dom_p2", "0.0D AS dom_p3", "1.0D AS dom_p4", "0.7D AS dom_mean", "'stale' AS h")
    got = wr.exported_effects(df).collect()
    want = [(-0.1, 0.5, False), (-0.1, 0.3, False), (-0.5, 0.5, False), (-0.5, 0.2, False), (0.0, 0.7, True)]
    assert all(abs(r.s - s) < 1e-12 and abs(r.h - h) < 1e-12 and r.used_fallback is f for r, (s, h, f) in zip(got, want, strict=True))


def test_panel_holds_what_was_asked_for(spark):
    schedule = [("n_seg", "jaccard", "every", 2), ("site_frequency_spectrum", "jaccard", "every", 3),
                ("pairwise_similarity", "dice", "every", 3), ("mean_fitness", "jaccard", "every", 3),
                ("mutation_histogram", "jaccard", "every", 3)]
    s = spark.createDataFrame([(*r, None, None, None) for r in schedule],
                              "stat STRING, metric STRING, kind STRING, step BIGINT, start BIGINT, end BIGINT, generations ARRAY<BIGINT>")
    h = spark.createDataFrame([(g, x) for g in (1, 2, 3, 4) for x in range(4)], "generation BIGINT, haplotype_id BIGINT")
    c = spark.createDataFrame([(g, x, 1) for g in (2, 3) for x in range(g)], "generation BIGINT, haplotype_id BIGINT, mutation_id BIGINT")
    m = spark.createDataFrame([(1, 0, "a", -0.5, 0.5)], "mutation_id BIGINT, chrom INT, type STRING, s DOUBLE, h DOUBLE")
    m = m.select("mutation_id", "chrom", "type", mutation_effects("s", "h", m.s < 0).alias("e")).selectExpr(
        "mutation_id", "chrom", "type", "e.hom_factor", "e.het_factor", "e.masking")
    types = spark.createDataFrame([("a",), ("b",)], ["type"])
    chromosomes = spark.createDataFrame([(0, 10)], "chrom INT, length BIGINT")
    panel = stat_panel(c, h, m, types, chromosomes, expand_schedules(s, 4))
    rows = {(r.generation, r.statistic): r for r in panel.collect()}
    assert set(rows) == {(2, "n_seg"), (4, "n_seg"), (3, "site_frequency_spectrum"), (3, "pairwise_similarity"),
                         (3, "mean_fitness"), (3, "mutation_histogram")}
    assert rows[2, "n_seg"].scalar_value == 1 and rows[4, "n_seg"].scalar_value == 0
    assert rows[3, "site_frequency_spectrum"].unfolded_sfs == [0, 0, 0, 1, 0]
    assert rows[3, "site_frequency_spectrum"].folded_sfs == [0, 1, 0]
    assert rows[3, "mutation_histogram"].by_type == [1, 0] and rows[3, "mutation_histogram"].by_chromosome == [1]
    assert abs(rows[3, "mean_fitness"].scalar_value - (0.5 + 0.75) / 2) < 1e-12
    assert rows[3, "pairwise_similarity"].metric == "dice" and rows[3, "pairwise_similarity"].scalar_value == 0.5
