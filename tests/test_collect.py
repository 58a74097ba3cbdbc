"""Run files to raw tables to summaries."""

from popstat.plans.collect import collect_runs
from popstat.plans.summarize import summarize_tables

HEADER = "generation\tdt_sec\tcumul_sec\tstatistic\tmetric\tscalar_value\tby_type\tby_chromosome\tunfolded_sfs\tfolded_sfs\n"
ERR = "Total wall-clock: {} sec\nAvg sec/gen: {}\nProfiler summary across 8 generations:\n  statistics   total=  1.500000  avg/gen=  0.187500  pct= 12.50%\n"


def test_files_become_tables_and_summaries(spark, tmp_path):
    def put(phase, case, name, out, err):
        folder = tmp_path / phase / case
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.stdout").write_text(out)
        (folder / f"{name}.stderr").write_text(err)

    for seed, n in ((101, 5), (202, 7)):
        rows = f"9\t0\t0\tn_seg\t\t{n - 1}\t\t\t\t\n10\t0\t0\tn_seg\t\t{n}\t\t\t\t\n10\t0\t0\tmutation_histogram\t\t\t1,2\t3\t\t\n"
        rows += "10\t0\t0\tsite_frequency_spectrum\t\t\t\t\t0,2,1\t0,3\n"
        put("accuracy", "c1", f"cand_psa_T4_seed{seed}", HEADER + rows, ERR.format(2.0, 0.2))
        put("accuracy", "c1", f"ref_seed{seed}", f"noise\nscalar\tn_seg\t{n + 1}\nvector\tsfs_unfolded\t0,1,2\n", "")
        put("speed", "c1", f"cand_psa_T4_seed{seed}", "", ERR.format(3.0, 0.3))
        put("profile", "c1", f"cand_psa_T4_seed{seed}", "", ERR.format(3.0, 0.3))
    put("speed", "c1", "cand_psa_T1_seed101", "", "it broke\n")
    scenarios = spark.createDataFrame([("c1", "s1", "a case", 10)], "case_label string, scenario_name string, scenario_description string, G long")
    tables = collect_runs(spark, str(tmp_path), scenarios, "ref")
    got = {(r.variant, r.replicate, r.metric): (r.value, r.generation) for r in tables["accuracy_scalars"].collect()}
    assert got["psa@T4", 2, "n_seg"] == (7.0, 10) and got["ref", 1, "n_seg"] == (6.0, 10)
    assert got["psa@T4", 1, "total_wall_sec"] == (2.0, 10) and len(got) == 8
    vectors = {(r.variant, r.seed, r.statistic): r.values_csv for r in tables["accuracy_vectors"].collect()}
    assert vectors["psa@T4", 101, "mutation_histogram_by_type"] == "1,2" and vectors["psa@T4", 101, "sfs_folded"] == "0,3"
    assert vectors["ref", 202, "sfs_unfolded"] == "0,1,2" and len(vectors) == 10
    assert sorted((r.threads, r.seed, r.ms_per_gen) for r in tables["speed_runs"].collect()) == [(4, 101, 300.0), (4, 202, 300.0)]
    assert [r.phase for r in tables["profile_phases"].collect()] == ["statistics"] * 2 and tables["scaling_runs"].count() == 0
    summaries = summarize_tables(tables, "ref")
    row = summaries["accuracy_scalar_comparison"].where("metric = 'n_seg'").first()
    assert (row.variant, row.alias_builder, row.threads, row.scenario_description) == ("psa@T4", "psa", 4, "a case")
    assert (row.mean, row.ref_mean, row.n_reps) == (6.0, 7.0, 2)
    over = summaries["accuracy_variant_overview"].first()
    assert (over.variant, over.alias_builder, over.threads) == ("psa@T4", "psa", 4) and over.max_vector_tvd > 0
