"""Bad fields and silent files of runs become rows, and the job goes on."""

from popstat.plans.collect import collect_rejects, collect_runs, collect_tables
from popstat.sources import readers as rd
from popstat.sources.schemas import STAT_ROW_COLUMNS

WALL = "Total wall-clock: 2.0 sec\nAvg sec/gen: 0.2\n"
PHASE = "  statistics   total=  {}  avg/gen=  0.187500  pct= 12.50%\n"


def test_bad_lines_and_silent_files(spark, tmp_path):
    def put(phase, name, text):
        folder = tmp_path / phase / "c1"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    put("accuracy", "cand_psa_T4_seed101.stdout", "\t".join(STAT_ROW_COLUMNS) + "\n9\t0\t0\tn_seg\t\t5\t\t\t\t\n10\t0\tsoon\tn_seg\t\tn/a\t\t\t\t\n"
        "10\t0\t0\tmutation_histogram\t\t\t1,x\t3\t\t\nxx\t0\t0\tn_seg\t\t5\t\t\t\t\n")
    put("accuracy", "cand_psa_T4_seed101.stderr", WALL)
    put("accuracy", "cand_psa_T4_seed202.stdout", "")
    put("accuracy", "cand_psa_T4_seed202.stderr", "")
    put("accuracy", "ref_seed101.stdout", "noise\nscalar\tn_seg\t6\nscalar\tload\t0.5.5\nvector\tsfs\t0,1.5\n")
    put("accuracy", "ref_seed101.stderr", "")
    put("speed", "cand_psa_T4_seed101.stderr", "Avg sec/gen: 0.2\nTotal wall-clock: 1.2.3 sec\n")
    put("profile", "cand_psa_T4_seed101.stderr", WALL + PHASE.format("1.5") + PHASE.format("1.5.5"))
    put("profile", "cand_psa_T4_seed202.stderr", WALL)
    put("profile", "notes.txt", "nothing")
    rejects = [(r.path.split("/")[-3], r.path.split("/")[-1], r.at is None, r.source, r.reason, r.text) for r in collect_rejects(spark, str(tmp_path), "ref").collect()]
    own, ref = "cand_psa_T4_seed101", "ref_seed101"
    assert sorted(rejects, key=str) == sorted([
        ("accuracy", f"{own}.stdout", False, "statistics", "cumul_sec, scalar_value", "10\t0\tsoon\tn_seg\t\tn/a\t\t\t\t"),
        ("accuracy", f"{own}.stdout", False, "statistics", "by_type", "10\t0\t0\tmutation_histogram\t\t\t1,x\t3\t\t"),
        ("accuracy", f"{own}.stdout", False, "statistics", "generation", "xx\t0\t0\tn_seg\t\t5\t\t\t\t"),
        ("accuracy", f"{ref}.stdout", False, "tagged", "value", "scalar\tload\t0.5.5"),
        ("accuracy", f"{ref}.stdout", False, "tagged", "value", "vector\tsfs\t0,1.5"),
        ("accuracy", "cand_psa_T4_seed202.stdout", True, "statistics", "nothing printed", None),
        ("accuracy", "cand_psa_T4_seed202.stderr", True, "wall", "no total, no average", None),
        ("speed", f"{own}.stderr", True, "wall", "no total", None),
        ("profile", f"{own}.stderr", False, "phases", "total_sec", PHASE.format("1.5.5").rstrip("\n")),
        ("profile", "cand_psa_T4_seed202.stderr", True, "phases", "no phase line", None),
        ("profile", "notes.txt", True, "file", "no run has this name", None),
    ], key=str)
    scenarios = spark.createDataFrame([("c1", "s1", "a case", 10)], "case_label string, scenario_name string, scenario_description string, G long")
    tables = collect_runs(spark, str(tmp_path), scenarios, "ref")
    got = {(r.variant, r.metric): r.value for r in tables["accuracy_scalars"].collect()}
    assert got["psa@T4", "n_seg"] == 5 and got["ref", "n_seg"] == 6 and ("ref", "load") not in got
    assert [r.total_sec for r in tables["profile_phases"].collect()] == [1.5] and tables["speed_runs"].count() == 0


def test_paths_are_taken_apart_once_a_file(spark, tmp_path):
    """Lines are joined with what their file's path tells; no line's path is matched."""
    folder = tmp_path / "accuracy" / "c1"
    folder.mkdir(parents=True)
    (folder / "cand_psa_T4_seed101.stdout").write_text("9\t0\t0\tn_seg\t\t5\t\t\t\t\n")
    (folder / "ref_seed101.stdout").write_text("scalar\tn_seg\t6\n")
    lines = rd.read_lines(spark, f"{folder}/*.stdout")
    scenarios = spark.createDataFrame([("c1", "s1", "a case", 10)], "case_label string, scenario_name string, scenario_description string, G long")
    scalars = collect_tables(lines, lines.where("false"), scenarios, "ref")["accuracy_scalars"]
    assert sorted((r.variant, r.value) for r in scalars.collect()) == [("psa@T4", 5.0), ("ref", 6.0)]
    assert "seed([0-9]+)" not in scalars._jdf.queryExecution().optimizedPlan().toString()


def test_bad_fields_of_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("generation,case_label,value,threads\n1,a,0.5,4\nx,b,0.5,4\n2,c,much,four\n3,,,\n")
    rows = rd.checked_result_table(spark, str(tmp_path / "t.csv"), "accuracy_scalars").collect()
    assert sorted((r.case_label or "", r.reject) for r in rows) == [("", None), ("a", None), ("b", "generation"), ("c", "threads, value")]
    assert rd.read_result_table(spark, str(tmp_path / "t.csv"), "accuracy_scalars").count() == 2
    assert "reject" in rd.checked_result_table(spark, str(tmp_path / "none.csv"), "speed_runs").columns
    raw = spark.createDataFrame([("1", "0", "0", "n_seg", None, "3", "", "", "1,2", None), (None,) * 10], ", ".join(f"{c} string" for c in STAT_ROW_COLUMNS))
    assert [(r.generation, r.unfolded_sfs, r.reject) for r in rd.checked_stat_rows(raw).collect()] == [(1, [1, 2], None), (None, None, "generation")]
