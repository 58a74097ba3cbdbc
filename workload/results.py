"""Queries of the result analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from popstat import functions as fn
from popstat.operators import filters as fl
from popstat.operators import results as rs
from popstat.plans.collect import collect_tables, rejected_lines
from popstat.session import scratch_path
from popstat.sources.readers import read_files, read_lines
from workload.registry import big, query, r6, r9
from workload.views import METRICS, SPEED_KEYS, VARIANT_KEYS, Views

BIOLOGICAL = ", ".join(f"'{m}'" for m in fl.BIOLOGICAL_METRICS)
_BIO = f"metric IN ({BIOLOGICAL})"


def _comparison(v: Views):
    return rs.compare_to_reference(v.scalar_summary, "ref")


def _comparison_with_meta(v: Views):
    """The case's description is made from its label."""
    runs = v.runs.withColumn("scenario_description", F.concat(F.lit("runs of "), "case_label"))
    summary = rs.with_meta(v.scalar_summary, runs, ["case_label", "simulator", "variant"])
    return rs.compare_to_reference(summary, "ref")


@query("rel_diff", """SELECT event_id, round(abs(value - user_id) / CASE WHEN abs(user_id) > 1e-12 THEN abs(user_id)
ELSE 1 END, 6) AS rel_diff FROM events""")
def _(v):
    return v.table("events").select("event_id", r6(fn.rel_diff("value", F.col("user_id").cast("double")), "rel_diff"))


@query("error_band", """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 WHEN value >= 100 THEN 3
WHEN value >= 50 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END AS band FROM events""")
def _(v):
    x = F.when(F.col("event_type") != "error", F.col("value") / 1000)
    return v.table("events").select("event_id", fn.error_band(x).alias("band"))


@query("label", """SELECT event_id, CASE alias_builder WHEN 'sequential' THEN 'Serial alias control'
WHEN 'parallel' THEN 'PSA alias' ELSE 'PSA+ alias' END AS builder,
CASE metric WHEN 'mean_fitness' THEN 'Mean fitness' WHEN 'genetic_load' THEN 'Genetic load'
 WHEN 'realized_masking_bonus' THEN concat('Realized masking', chr(10), 'bonus') WHEN 'exact_B' THEN 'Exact B'
 WHEN 'n_seg' THEN concat('Segregating', chr(10), 'mutations')
 WHEN 'n_fixed' THEN concat('Fixed', chr(10), 'mutations')
 WHEN 'nucleotide_diversity' THEN concat('Nucleotide', chr(10), 'diversity')
 WHEN 'expected_heterozygosity' THEN concat('Expected', chr(10), 'heterozygosity')
 ELSE replace(metric, '_', ' ') END AS metric FROM runs""")
def _(v):
    return v.runs.select(
        "event_id", fn.label("alias_builder", fn.BUILDER_LABELS, "same").alias("builder"),
        fn.label("metric", fn.METRIC_LABELS).alias("metric"),
    )


@query("kb_to_gib", """SELECT event_id, round(TRY_CAST(peak_rss_kb AS DOUBLE) / 1048576, 6) AS gib FROM runs
WHERE TRY_CAST(peak_rss_kb AS DOUBLE) IS NOT NULL""")
def _(v):
    gib = v.runs.select("event_id", fn.kb_to_gib("peak_rss_kb").alias("gib"))
    return gib.where(fn.finite("gib")).select("event_id", r6("gib"))


@query("variant_label", "SELECT event_id, concat(alias_builder, '@T', CAST(threads AS VARCHAR)) AS variant FROM runs")
def _(v):
    return v.runs.select("event_id", fn.variant_label("alias_builder", "threads").alias("variant"))


@query("per_generation", """SELECT event_id, round(total_sec / (event_id % 50 + 1), 9) AS avg_sec_per_gen,
round(total_sec / (event_id % 50 + 1) * 1000, 9) AS ms_per_gen FROM runs""")
def _(v):
    p = v.runs.select("event_id", fn.per_generation("total_sec", F.col("event_id") % 50 + 1).alias("p"))
    return p.select("event_id", r9("p.avg_sec_per_gen", "avg_sec_per_gen"), r9("p.ms_per_gen", "ms_per_gen"))


@query("parse_int_vector", """SELECT event_id, concat(user_id, ',', event_id) AS vector, 2 AS n,
user_id + event_id AS total FROM events""")
def _(v):
    text = F.concat_ws(",", F.col("user_id"), F.lit(""), F.col("event_id"), F.lit(""))
    vectors = v.table("events").select("event_id", fn.parse_int_vector(text).alias("a"))
    return vectors.select(
        "event_id", fn.format_int_vector("a").alias("vector"), F.size("a").alias("n"),
        F.aggregate("a", F.lit(0).cast("long"), lambda x, y: x + y).alias("total"),
    )


@query("format_scalar", "SELECT event_id, printf('%.10f', value / 8) AS text FROM events")
def _(v):
    return v.table("events").select("event_id", fn.format_scalar(F.col("value") / 8).alias("text"))


# ---- filters ----


@query("biological_metrics", f"SELECT event_id, metric FROM runs WHERE {_BIO}")
def _(v):
    return fl.biological_metrics(v.runs).select("event_id", "metric")


@query("prefer_variant", "SELECT event_id, variant FROM runs WHERE variant LIKE '%parallel_psa_plus%'")
def _(v):
    return fl.prefer_variant(v.runs, "parallel_psa_plus", "ref").select("event_id", "variant")


@query("prefer_variant_absent", "SELECT event_id, variant FROM runs WHERE variant <> 'ref'")
def _(v):
    return fl.prefer_variant(v.runs, "no_such_builder", "ref").select("event_id", "variant")


@query("at_max", """SELECT case_label, alias_builder, threads, phase, total_sec FROM phases
WHERE threads = (SELECT max(threads) FROM phases) AND phase <> 'total'""")
def _(v):
    return fl.at_max(v.phases).select("case_label", "alias_builder", "threads", "phase", "total_sec")


# ---- replicates and accuracy ----


@query("replicate_summary", """SELECT case_label, simulator, variant, metric, n_reps, round(mean, 6) AS mean,
round(sd, 6) AS sd FROM scalar_summary""")
def _(v):
    return v.scalar_summary.select(*VARIANT_KEYS, "n_reps", r6("mean"), r6("sd"))


@query("optional_summary", """SELECT case_label, metric, round(avg(x), 6) AS mean,
round(CASE WHEN count(x) > 0 THEN coalesce(stddev_samp(x), 0) END, 6) AS sd
FROM (SELECT *, TRY_CAST(peak_vmsize_kb AS DOUBLE) AS x FROM runs) GROUP BY 1, 2""")
def _(v):
    return rs.optional_summary(v.runs, ["case_label", "metric"], "peak_vmsize_kb", missing=None).select(
        "case_label", "metric", r6("mean"), r6("sd")
    )


@query("compare_to_reference", """SELECT case_label, concat('runs of ', case_label) AS scenario_description, variant,
split_part(variant, '@T', 1) AS alias_builder, CAST(split_part(variant, '@T', 2) AS BIGINT) AS threads,
metric, n_reps, ref_n, round(mean, 6) AS mean,
round(ref_mean, 6) AS ref_mean, round(ref_sd, 6) AS ref_sd, round(abs_diff, 6) AS abs_diff,
round(rel_diff, 6) AS rel_diff FROM comparison""")
def _(v):
    return _comparison_with_meta(v).select(
        "case_label", "scenario_description", "variant", "alias_builder", "threads", "metric", "n_reps", "ref_n", r6("mean"), r6("ref_mean"), r6("ref_sd"),
        r6("abs_diff"), r6("rel_diff"),
    )


_WORDS = "(SELECT lang, source, string_split(text, ' ') AS words FROM documents)"


@query("mean_vector", f"""SELECT s.lang, s.source, s.pos, round(s.total / n.n, 6) AS mean_value FROM
(SELECT lang, source, pos, sum(length(words[pos + 1])) AS total FROM
  (SELECT lang, source, words, unnest(range(len(words))) AS pos FROM {_WORDS}) GROUP BY 1, 2, 3) s
JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) n ON n.lang = s.lang AND n.source = s.source""")
def _(v):
    """Mean word length at each place of a text: vectors of very unequal length."""
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w))
    texts = v.table("documents").select("lang", "source", lengths.alias("lengths"))
    return rs.mean_vector(texts, ["lang", "source"], "lengths").select("lang", "source", big("pos"), r6("mean_value"))


@query("normalized_distribution", "SELECT case_label, simulator, pos, round(share, 6) AS share FROM shares")
def _(v):
    return v.shares.select("case_label", "simulator", "pos", r6("share"))


_DISTANCE = """(SELECT coalesce(a.case_label, b.case_label) AS case_label,
  abs(coalesce(a.share, 0) - coalesce(b.share, 0)) AS gap
  FROM (SELECT * FROM shares WHERE simulator = 'F') a
  FULL JOIN (SELECT * FROM shares WHERE simulator = 'O') b ON a.case_label = b.case_label AND a.pos = b.pos)"""


def _sides(v: Views):
    return [v.shares.where(F.col("simulator") == s) for s in ("F", "O")]


@query("total_variation_distance", f"SELECT case_label, round(sum(gap) / 2, 6) AS tvd FROM {_DISTANCE} GROUP BY 1")
def _(v):
    return rs.total_variation_distance(*_sides(v), ["case_label"]).select("case_label", r6("tvd"))


@query("max_abs_bin_diff", f"SELECT case_label, round(max(gap), 6) AS max_bin_abs_diff FROM {_DISTANCE} GROUP BY 1")
def _(v):
    return rs.max_abs_bin_diff(*_sides(v), ["case_label"]).select("case_label", r6("max_bin_abs_diff"))


def _variant_distances(v: Views):
    """A distance per variant, under a name that no comparison has for those with an odd number of runs."""
    name = F.when(F.count(F.lit(1)) % 2 == 1, F.concat("variant", F.lit("-only"))).otherwise(F.col("variant"))
    return v.runs.groupBy("variant", "alias_builder", "threads").agg((F.max("value") / 1000).alias("tvd"), name.alias("named")).select(
        F.col("named").alias("variant"), "alias_builder", "threads", "tvd")


_DISTANCES = """(SELECT named AS variant, max(alias_builder) AS alias_builder, max(threads) AS threads, max(tvd) AS tvd FROM
(SELECT CASE WHEN count(*) % 2 = 1 THEN concat(variant, '-only') ELSE variant END AS named, alias_builder, threads,
  max(value) / 1000 AS tvd FROM runs GROUP BY variant, alias_builder, threads) GROUP BY 1)"""


@query("worst_error_per_variant", f"""SELECT coalesce(s.variant, d.variant) AS variant,
coalesce(s.alias_builder, d.alias_builder) AS alias_builder, coalesce(s.threads, d.threads) AS threads,
round(coalesce(s.e, 0), 6) AS max_scalar_rel_diff, round(coalesce(d.tvd, 0), 6) AS max_vector_tvd FROM
(SELECT variant, split_part(variant, '@T', 1) AS alias_builder, CAST(split_part(variant, '@T', 2) AS BIGINT) AS threads,
  max(CASE WHEN {_BIO} THEN rel_diff END) AS e FROM comparison GROUP BY 1) s FULL JOIN {_DISTANCES} d ON s.variant = d.variant""")
def _(v):
    return rs.worst_error_per_variant(_comparison_with_meta(v), _variant_distances(v)).select(
        "variant", "alias_builder", "threads", r6("max_scalar_rel_diff"), r6("max_vector_tvd")
    )


@query("merge_variant_maxima", """SELECT coalesce(s.variant, d.variant) AS variant, round(coalesce(s.e, 0), 6)
AS max_scalar_rel_diff, round(coalesce(d.t, 0), 6) AS max_vector_tvd FROM
(SELECT CASE WHEN variant LIKE '%T1' THEN concat(variant, '-s') ELSE variant END AS variant, max(value) AS e FROM runs GROUP BY 1) s FULL JOIN
(SELECT CASE WHEN variant LIKE '%T2' THEN concat(variant, '-v') ELSE variant END AS variant, min(value) AS t FROM runs GROUP BY 1) d
ON s.variant = d.variant""")
def _(v):
    """Variants of one thread are named anew on one side and those of two on the other, so neither finds its partner."""
    def renamed(end: str, mark: str):
        name = F.when(F.col("variant").endswith(end), F.concat("variant", F.lit(mark))).otherwise(F.col("variant"))
        return v.runs.groupBy(name.alias("variant"))

    scalar = renamed("T1", "-s").agg(F.max("value").alias("max_scalar_rel_diff"))
    vector = renamed("T2", "-v").agg(F.min("value").alias("max_vector_tvd"))
    return rs.merge_variant_maxima(scalar, vector).select(
        "variant", r6("max_scalar_rel_diff"), r6("max_vector_tvd")
    )


_GRID = ", ".join(f"round(avg(CASE WHEN metric = '{m}' THEN rel_diff END), 6) AS {m.lower()}" for m in METRICS)


@query("accuracy_grid", f"SELECT case_label, {_GRID} FROM comparison GROUP BY 1")
def _(v):
    grid = rs.accuracy_grid(_comparison(v), METRICS)
    return grid.select("case_label", *[r6(m, m.lower()) for m in METRICS])


_BANDS = ", ".join(
    f"CASE WHEN {a} >= 0.10 THEN 3 WHEN {a} >= 0.05 THEN 2 WHEN {a} >= 0.01 THEN 1 ELSE 0 END AS {m.lower()}"
    for m in METRICS for a in [f"avg(CASE WHEN metric = '{m}' THEN rel_diff END)"]
)


@query("accuracy_bands", f"SELECT case_label, {_BANDS} FROM comparison GROUP BY 1")
def _(v):
    grid = rs.accuracy_grid(_comparison(v), METRICS, banded=True)
    return grid.select("case_label", *[F.col(m).alias(m.lower()) for m in METRICS])


# ---- speed ----

_SPEED_NUMBERS = [
    f"{a}_{b}" for b in ("ms_per_gen", "total_sec", "peak_rss_kb", "peak_vmsize_kb") for a in ("mean", "sd")
]


@query("speed_summary", "SELECT case_label, simulator, alias_builder, threads, n_reps, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _SPEED_NUMBERS) + " FROM speed")
def _(v):
    return v.speed.select(*SPEED_KEYS, "n_reps", *[r6(c) for c in _SPEED_NUMBERS])


@query("best_config", """SELECT case_label, alias_builder, best_threads, round(best_mean_ms_per_gen, 6)
AS best_mean_ms_per_gen, round(best_sd_ms_per_gen, 6) AS best_sd_ms_per_gen FROM best""")
def _(v):
    best = rs.best_config(v.speed.where("simulator <> 'ref'"))
    return best.select(
        "case_label", "alias_builder", "best_threads", r6("best_mean_ms_per_gen"), r6("best_sd_ms_per_gen")
    )


@query("attach_reference_speed", """SELECT b.case_label, b.alias_builder, round(r.ref_mean_ms_per_gen, 6)
AS ref_mean_ms_per_gen, round(r.ref_mean_ms_per_gen / b.best_mean_ms_per_gen, 6) AS speedup_vs_ref
FROM best b LEFT JOIN (SELECT CASE WHEN case_label = 'error' THEN 'other' ELSE case_label END AS case_label, ref_mean_ms_per_gen
FROM ref_speed) r ON b.case_label = r.case_label""")
def _(v):
    """The reference of one case goes by another name, so that case has none."""
    best = rs.best_config(v.speed.where("simulator <> 'ref'"))
    other = F.when(F.col("case_label") == "error", "other").otherwise(F.col("case_label"))
    joined = rs.attach_reference_speed(best, v.ref_speed.withColumn("case_label", other), missing=None)
    return joined.select("case_label", "alias_builder", r6("ref_mean_ms_per_gen"), r6("speedup_vs_ref"))


@query("speedup_vs_reference", """SELECT b.case_label, b.alias_builder, b.best_threads,
round(r.ref_mean_ms_per_gen / b.best_mean_ms_per_gen, 6) AS speedup_vs_ref
FROM best b LEFT JOIN ref_speed r ON b.case_label = r.case_label""")
def _(v):
    """The reference runs once per case, on one thread and without a builder."""
    is_ref = F.col("simulator") == "ref"
    by_case = v.runs.withColumn("alias_builder", F.when(is_ref, "").otherwise(F.col("alias_builder")))
    by_case = by_case.withColumn("threads", F.when(is_ref, 1).otherwise(F.col("threads")))
    speed = rs.speed_summary(by_case, SPEED_KEYS, missing=None)
    return rs.speedup_vs_reference(speed, "ref", missing=None).select(
        "case_label", "alias_builder", "best_threads", r6("speedup_vs_ref")
    )


@query("speedup_ranking", """SELECT b.case_label, round(max(r.ref_mean_ms_per_gen / b.best_mean_ms_per_gen), 6)
AS best_speedup FROM best b LEFT JOIN ref_speed r ON b.case_label = r.case_label GROUP BY 1 ORDER BY 2 DESC""")
def _(v):
    best = rs.best_config(v.speed.where("simulator <> 'ref'"))
    ranked = rs.speedup_ranking(rs.attach_reference_speed(best, v.ref_speed))
    return ranked.select("case_label", r6("best_speedup"))


_SCALING = "SELECT case_label, alias_builder, threads, avg(ms_per_gen) AS m FROM runs GROUP BY 1, 2, 3"
_BASE = f"""(SELECT s.*, coalesce(b.m, s.m) AS base FROM ({_SCALING}) s
LEFT JOIN ({_SCALING}) b ON b.case_label = s.case_label AND b.alias_builder = s.alias_builder AND b.threads = 1)"""
_SCALING_KEYS = ["case_label", "alias_builder", "threads"]


@query("attach_baseline", f"""SELECT case_label, alias_builder, threads, round(m, 6) AS mean_ms_per_gen,
round(base, 6) AS baseline_ms_per_gen FROM {_BASE}""")
def _(v):
    return rs.attach_baseline(rs.speed_summary(v.runs, _SCALING_KEYS)).select(
        *_SCALING_KEYS, r6("mean_ms_per_gen"), r6("baseline_ms_per_gen")
    )


@query("scaling_efficiency", f"""SELECT case_label, alias_builder, threads, round(base / m, 6) AS speedup_vs_t1,
round(base / m / threads, 6) AS parallel_efficiency FROM {_BASE}""")
def _(v):
    return rs.scaling_efficiency(rs.speed_summary(v.runs, _SCALING_KEYS)).select(
        *_SCALING_KEYS, r6("speedup_vs_t1"), r6("parallel_efficiency")
    )


# ---- phases ----


@query("profile_totals", """SELECT s.case_label, s.phase, round(s.t, 6) AS total_sec, round(s.a, 6) AS avg_sec_per_gen,
round(coalesce(100 * s.t / w.t, 0), 6) AS pct_total FROM
(SELECT case_label, phase, sum(total_sec) AS t, avg(total_sec) AS a FROM phases GROUP BY 1, 2) s
LEFT JOIN (SELECT case_label, sum(total_sec) AS t FROM phases WHERE phase = 'total' GROUP BY 1) w
ON s.case_label = w.case_label""")
def _(v):
    long = v.phases.select("case_label", "phase", F.col("total_sec").alias("sec"))
    return rs.profile_totals(long, ["case_label"]).select(
        "case_label", "phase", r6("total_sec"), r6("avg_sec_per_gen"), r6("pct_total")
    )


@query("unpivot_profile", """SELECT event_id, phase, round(sec, 6) AS sec FROM (
SELECT event_id, unnest(['build_parent_sampler', 'statistics', 'total']) AS phase,
unnest([value, CAST(user_id AS DOUBLE), value + user_id]) AS sec FROM events)""")
def _(v):
    wide = v.table("events").select(
        "event_id", F.col("value").alias("build_parent_sampler"), F.col("user_id").alias("statistics"),
        (F.col("value") + F.col("user_id")).alias("total"),
    )
    long = rs.unpivot_profile(wide, ["event_id"], ["build_parent_sampler", "statistics", "total"])
    return long.select("event_id", "phase", r6("sec"))


_PHASE_NUMBERS = [f"{a}_{b}" for b in ("total_sec", "avg_sec_per_gen", "pct_total") for a in ("mean", "sd")]
_PHASE_SQL = ", ".join(
    f"round({'avg(' + b + ')' if a == 'mean' else 'coalesce(stddev_samp(' + b + '), 0)'}, 9) AS {a}_{b}"
    for b in ("total_sec", "avg_sec_per_gen", "pct_total") for a in ("mean", "sd")
)


@query("phase_summary", f"""SELECT case_label, alias_builder, threads, phase, count(*) AS n_reps, {_PHASE_SQL}
FROM phases GROUP BY 1, 2, 3, 4""")
def _(v):
    return rs.phase_summary(v.phases).select(
        "case_label", "alias_builder", "threads", "phase", "n_reps", *[r9(c) for c in _PHASE_NUMBERS]
    )


_GROUP_SQL = """(SELECT case_label, alias_builder, CASE phase WHEN 'parallel_reproduction' THEN 'Reproduction'
WHEN 'build_parent_sampler' THEN 'Alias build' WHEN 'merge_thread_counts' THEN 'Merge thread counts'
WHEN 'classify_mutations' THEN 'Classify mutations' WHEN 'offspring_copy_and_count' THEN 'Copy and count'
WHEN 'zero_offspring_counts' THEN 'Zero counts' ELSE 'Minor phases' END AS phase_group, mean_pct_total
FROM phase_means WHERE threads = 8 AND phase <> 'total')"""


def _shares(v: Views):
    return rs.phase_group_shares(fl.at_max(rs.phase_summary(v.phases)))


@query("phase_group_shares", f"""SELECT case_label, alias_builder, phase_group,
round(sum(mean_pct_total), 6) AS mean_pct_total FROM {_GROUP_SQL} GROUP BY 1, 2, 3""")
def _(v):
    return _shares(v).select("case_label", "alias_builder", "phase_group", r6("mean_pct_total"))


@query("share_guard", f"""SELECT case_label, alias_builder, round(sum(mean_pct_total), 6) AS pct_sum FROM {_GROUP_SQL}
GROUP BY 1, 2 HAVING sum(mean_pct_total) < 95 OR sum(mean_pct_total) > 100.5""")
def _(v):
    return rs.share_guard(_shares(v)).select("case_label", "alias_builder", r6("pct_sum"))


@query("sample_bad_groups", f"""SELECT case_label, alias_builder, round(sum(mean_pct_total), 6) AS pct_sum
FROM {_GROUP_SQL} GROUP BY 1, 2 HAVING sum(mean_pct_total) < 95 OR sum(mean_pct_total) > 100.5
ORDER BY 1, 2 LIMIT 5""")
def _(v):
    bad = rs.share_guard(_shares(v)).select("case_label", "alias_builder", r6("pct_sum"))
    return rs.sample_bad_groups(bad, ["case_label", "alias_builder"])


# ---- unions and order ----


@query("union_results", """SELECT case_label, variant, NULL AS alias_builder, value FROM runs
UNION ALL SELECT case_label, NULL, alias_builder, NULL FROM speed""")
def _(v):
    return rs.union_results([
        v.runs.select("case_label", "variant", "value"), v.speed.select("case_label", "alias_builder")
    ]).select("case_label", "variant", "alias_builder", "value")


@query("last_wins", """SELECT user_id, event_type, event_id, value FROM (SELECT *,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(v):
    latest = rs.last_wins(v.table("events").drop("props"), ["user_id", "event_type"], ["ts", "event_id"])
    return latest.select("user_id", "event_type", "event_id", "value")


@query("first_appearance", "SELECT user_id, min(event_id) AS first_at FROM events GROUP BY 1 ORDER BY 2")
def _(v):
    return rs.first_appearance(v.table("events"), "user_id", "event_id")


@query("summary_order", """SELECT alias_builder, threads, count(*) AS n FROM runs GROUP BY 1, 2
ORDER BY threads, alias_builder""")
def _(v):
    counted = v.runs.groupBy("alias_builder", "threads").agg(F.count(F.lit(1)).alias("n"))
    return rs.summary_order(counted, ["threads", "alias_builder"])


# ---- run files ----

@query("collect_runs", """SELECT 'accuracy' AS kind, event_type AS case_label,
CASE WHEN event_id % 2 = 0 THEN 'ref' ELSE 'psa@T4' END AS variant, (user_id % 3 + 1) * 101 AS seed, metric, round(value, 4) AS value
FROM (SELECT event_type, event_id % 2 AS event_id, user_id % 3 AS user_id, 'n_seg' AS metric, arg_max(value, event_id) AS value
  FROM events GROUP BY 1, 2, 3
UNION ALL SELECT event_type, 1, user_id % 3, 'total_wall_sec', min(value) FROM events WHERE event_id % 2 = 1 GROUP BY 1, 3
UNION ALL SELECT event_type, 1, user_id % 3, 'avg_sec_per_gen', 0.5 FROM events WHERE event_id % 2 = 1 GROUP BY 1, 3)""")
def _(v):
    """Run files are written from events, read back with their paths and turned into the raw table of scalars.

    A run of the reference prints its last value as a tagged metric, the others a row a
    generation; the wall times are on their error output. A long run is several part files, in ranges of its rows.
    """
    events = v.table("events").withColumn("seed", (F.col("user_id") % 3 + 1) * 101).withColumn("ref", F.col("event_id") % 2 == 0)
    run = F.when(F.col("ref"), F.concat(F.lit("ref_seed"), "seed")).otherwise(F.concat(F.lit("cand_psa_T4_seed"), "seed"))
    named = events.withColumn("run", run)
    row = F.concat_ws("\t", "event_id", F.lit("0"), F.lit("0"), F.lit("n_seg"), F.lit(""), F.format_string("%.4f", "value"), *[F.lit("")] * 4)
    rows = named.where("not ref").select("event_type", "run", F.col("event_id").alias("n"), row.alias("value"))
    runs = named.groupBy("event_type", "run", "ref").agg(F.max_by("value", "event_id").alias("last"), F.min("value").alias("least"))
    tagged = runs.where("ref").select("event_type", "run", F.lit(0).cast("long").alias("n"), F.format_string("scalar\tn_seg\t%.4f", "last").alias("value"))
    wall = runs.where("not ref").select("event_type", "run", F.lit(0).cast("long").alias("n"),
                                        F.format_string("Total wall-clock: %.4f sec\nAvg sec/gen: 0.5", "least").alias("value"))
    folder = scratch_path(v.spark, "runs")
    for end, lines in (("stdout", rows.unionByName(tagged)), ("stderr", wall)):
        files = lines.repartitionByRange("event_type", "run", "n").sortWithinPartitions("event_type", "run", "n")
        files.select("value", "event_type", F.concat("run", F.lit(f".{end}")).alias("file")).write.partitionBy("event_type", "file").text(f"{folder}/{end}")
    layout = F.regexp_replace("path", "event_type=([^/]+)/file=([^/]+)/.*$", "accuracy/$1/$2")
    out, err = (read_lines(v.spark, f"{folder}/{end}").withColumn("path", layout) for end in ("stdout", "stderr"))
    cases = v.table("events").select(F.col("event_type").alias("case_label")).distinct().select(
        "case_label", F.col("case_label").alias("scenario_name"), F.lit("").alias("scenario_description"), F.lit(1).cast("long").alias("G"))
    scalars = collect_tables(out, err, cases, "ref")["accuracy_scalars"]
    return scalars.select(F.lit("accuracy").alias("kind"), "case_label", "variant", "seed", "metric", F.round("value", 4).alias("value"))


@query("collect_rejects", """SELECT 'statistics' AS source, 'scalar_value' AS reason, event_type AS case_label,
'cand_psa_T4_seed' || ((user_id % 3 + 1) * 101) || '.stdout' AS file, event_id || E'\\t0\\t0\\tn_seg\\t\\tn/a\\t\\t\\t\\t' AS text
FROM events WHERE event_id % 2 = 1 AND event_id % 7 = 0
UNION ALL SELECT 'tagged', 'value', event_type, 'ref_seed' || ((user_id % 3 + 1) * 101) || '.stdout', E'scalar\\tm' || event_id || E'\\t1,5'
FROM events WHERE event_id % 14 = 0
UNION ALL SELECT DISTINCT 'wall', 'no average', event_type, 'cand_psa_T4_seed101.stderr', NULL FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0
UNION ALL SELECT DISTINCT 'wall', 'no total, no average', event_type, 'cand_psa_T4_seed202.stderr', NULL
FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 1""")
def _(v):
    """Run files with some values that are no numbers, logs that lack the average and logs that say nothing of times."""
    events = v.table("events").withColumn("seed", (F.col("user_id") % 3 + 1) * 101)
    ref, n = F.col("event_id") % 2 == 0, F.col("event_id")
    run = F.when(ref, F.concat(F.lit("ref_seed"), "seed")).otherwise(F.concat(F.lit("cand_psa_T4_seed"), "seed"))
    number = F.when(n % 7 == 0, F.when(ref, "1,5").otherwise("n/a")).otherwise(F.format_string("%.4f", "value"))
    row = F.concat_ws("\t", "event_id", F.lit("0"), F.lit("0"), F.lit("n_seg"), F.lit(""), number, *[F.lit("")] * 4)
    out = events.select("event_type", run.alias("run"), n.alias("n"), F.when(ref, F.concat(F.lit("scalar\tm"), "event_id", F.lit("\t"), number)).otherwise(row).alias("value"))
    said = F.when(F.col("seed") == 202, "it broke").when(F.col("seed") == 101, "Total wall-clock: 2.5 sec").otherwise("Total wall-clock: 2.5 sec\nAvg sec/gen: 0.5")
    err = events.where(~ref).select("event_type", run.alias("run"), F.lit(0).cast("long").alias("n"), said.alias("value")).distinct()
    folder = scratch_path(v.spark, "runs")
    for end, lines in (("stdout", out), ("stderr", err)):
        files = lines.repartitionByRange("event_type", "run", "n").select("value", "event_type", F.concat("run", F.lit(f".{end}")).alias("file"))
        files.write.partitionBy("event_type", "file").text(f"{folder}/{end}")
    layout = F.regexp_replace("path", "event_type=([^/]+)/file=([^/]+)/.*$", "accuracy/$1/$2")
    out, err = (read_lines(v.spark, f"{folder}/{end}").withColumn("path", layout) for end in ("stdout", "stderr"))
    listed = read_files(v.spark, f"{folder}/stdout").unionByName(read_files(v.spark, f"{folder}/stderr")).select(layout.alias("path")).distinct()
    found = rejected_lines(out, err, listed, "ref")
    part = lambda k: F.regexp_extract("path", "accuracy/([^/]+)/([^/]+)$", k)
    return found.select("source", "reason", part(1).alias("case_label"), part(2).alias("file"), "text")
