"""From the files that runs leave to the raw tables of a results folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popstat.functions.text import format_int_vector, variant_label
from popstat.sources.readers import (
    checked_phase_profile,
    checked_stat_rows,
    checked_tagged_metrics,
    extract_phase_profile,
    extract_wall_metrics,
    read_files,
    read_lines,
    read_tagged_metrics,
    with_run_context,
)
from popstat.session import cut_lineage
from popstat.sources.schemas import RESULT_TABLES, STAT_ROW_COLUMNS

SEED_STEP = 101
# The vectors that a histogram row and a spectrum row hold
VECTORS = {
    "mutation_histogram": {"mutation_histogram_by_type": "by_type", "mutation_histogram_by_chromosome": "by_chromosome"},
    "site_frequency_spectrum": {"sfs_unfolded": "unfolded_sfs", "sfs_folded": "folded_sfs"},
}
WALL_METRICS = ("total_wall_sec", "avg_sec_per_gen")


def _checked_statistics(lines: DataFrame) -> DataFrame:
    """Statistic rows of each file with ``path``, ``at``, ``value`` and ``reject``; header and blank lines are left out."""
    fields = F.split("value", "\t")
    rows = lines.where(F.trim("value") != "").where(~F.col("value").startswith("generation\t"))
    named = [F.coalesce(F.get(fields, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(STAT_ROW_COLUMNS)]
    return checked_stat_rows(rows.select("path", "at", "value", *named), ["path", "at", "value"])


def run_statistics(lines: DataFrame) -> DataFrame:
    """``path``, ``generation``, ``name``, ``scalar_value``, ``vector_value``: the last row of each statistic of a run.

    A histogram and a spectrum row are two vectors each. The generation is the last of the run.
    """
    rows = _checked_statistics(lines).where("reject is null")
    vector = [
        F.struct(F.lit(name).alias("name"), F.lit(None).cast("double").alias("scalar_value"), F.col(c).alias("vector_value"))
        for parts in VECTORS.values() for name, c in parts.items()
    ]
    scalar = F.struct(F.col("statistic").alias("name"), "scalar_value", F.lit(None).cast("array<long>").alias("vector_value"))
    parts = F.when(F.col("scalar_value").isNotNull(), F.array(scalar))
    for i, statistic in enumerate(VECTORS):
        parts = parts.when(F.col("statistic") == statistic, F.array(*vector[2 * i : 2 * i + 2]))
    named = rows.select("path", "generation", "at", F.explode(parts).alias("p")).select("path", "generation", "at", "p.*")
    last = named.groupBy("path", "name").agg(F.max_by(F.struct("scalar_value", "vector_value"), F.struct("generation", "at")).alias("_v"))
    ends = rows.groupBy("path").agg(F.max("generation").alias("generation"))
    return last.join(ends, "path").select("path", "generation", "name", "_v.*")


def _run_contexts(*lines: DataFrame) -> DataFrame:
    """What the path of each run file tells, written: paths are taken apart once a file, not once a line."""
    paths = [df.select("path").distinct() for df in lines]
    every = paths[0]
    for more in paths[1:]:
        every = every.unionByName(more)
    return cut_lineage(with_run_context(every.distinct()))


def collect_tables(stdout: DataFrame, stderr: DataFrame, scenarios: DataFrame, reference: str) -> dict[str, DataFrame]:
    """The six raw tables, as in ``RESULT_TABLES``, of the lines of run files.

    ``stdout`` and ``stderr`` are lines with ``path`` and ``at`` (``read_lines``); the path
    tells phase, case, simulator, builder, threads and seed. ``scenarios`` has case_label,
    scenario_name, scenario_description and G. The reference simulator prints tagged metrics,
    the others statistic rows. A run without both wall times is in no speed table.
    """
    contexts = _run_contexts(stdout, stderr)
    context = lambda df: df.join(contexts, "path").join(scenarios, "case_label", "left").withColumn(
        "replicate", (F.col("seed") / SEED_STEP).cast("long")
    )
    is_ref = F.col("simulator") == reference
    variant = F.when(is_ref, F.lit(reference)).otherwise(variant_label("alias_builder", "threads"))
    by_run = stdout.join(contexts, "path")
    tagged = read_tagged_metrics(by_run.where(is_ref), keep=["path"])
    printed = run_statistics(by_run.where(~is_ref))
    wall = extract_wall_metrics(stderr).where("complete")
    times = wall.select("path", F.lit(None).cast("long").alias("generation"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(c).alias("scalar_value"), F.lit(None).cast("array<long>").alias("vector_value"))
        for n, c in zip(WALL_METRICS, ("total_sec", "avg_sec_per_gen"), strict=True)
    ])))
    tags = tagged.select(
        "path", F.lit(None).cast("long").alias("generation"), "name", "scalar_value",
        F.col("vector_value").cast("array<long>").alias("vector_value"),
    )
    named = lambda df: context(df).where("run_phase = 'accuracy'").withColumn("variant", variant)
    own = named(printed.unionByName(times)).where(~is_ref).unionByName(named(tags))
    own = own.withColumn("generation", F.coalesce("generation", F.col("G").cast("long")))
    runs = context(wall).withColumn("ms_per_gen", F.col("avg_sec_per_gen") * 1000)
    runs = runs.withColumns({c: F.lit(None).cast("string") for c in ("peak_rss_kb", "peak_vmsize_kb")})
    phases = context(extract_phase_profile(stderr)).where("run_phase = 'profile'")
    made = {
        "accuracy_scalars": own.where("scalar_value is not null").withColumns({"metric": F.col("name"), "value": F.col("scalar_value")}),
        "accuracy_vectors": own.where("vector_value is not null").withColumns(
            {"statistic": F.col("name"), "values_csv": format_int_vector("vector_value")}),
        **{f"{p}_runs": runs.where(F.col("run_phase") == p) for p in ("speed", "scaling", "profile")},
        "profile_phases": phases,
    }
    typed = lambda df, schema: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return {name: typed(made[name], schema) for name, schema in RESULT_TABLES.items()}


def collect_runs(spark: SparkSession, folder: str, scenarios: DataFrame, reference: str) -> dict[str, DataFrame]:
    """The raw tables of the run files below ``folder``/<phase>/<case>/; input of ``summarize_tables``."""
    out, err = (read_lines(spark, f"{folder}/*/*/*.{end}") for end in ("stdout", "stderr"))
    return collect_tables(out, err, scenarios, reference)


REJECTS = ("path", "at", "source", "reason", "text")


def rejected_lines(stdout: DataFrame, stderr: DataFrame, files: DataFrame, reference: str) -> DataFrame:
    """What of the run files is in no raw table: ``path``, ``at``, ``source``, ``reason`` and ``text``.

    ``stdout`` and ``stderr`` are as for :func:`collect_tables`, ``files`` (``path``) are all
    run files, so that those without any line count. Lines with a field that does not read
    have their place ``at`` and ``text``; their ``source`` is statistics, tagged or phases and
    ``reason`` names the fields. A file has a row without place: of source wall if its error
    output lacks a time that reads (a reference's accuracy run prints none), phases if
    a profile run has no phase line, statistics or tagged if an accuracy run printed nothing
    that is read, and file if its name is none of a run.
    """
    is_ref = F.col("simulator") == reference
    by_run = stdout.join(_run_contexts(stdout), "path")
    own = _checked_statistics(by_run.where(~is_ref)).withColumn("source", F.lit("statistics"))
    tagged = checked_tagged_metrics(by_run.where(is_ref), keep=["path", "at", "value"]).withColumn("source", F.lit("tagged"))
    phases = checked_phase_profile(stderr, keep=["path", "at", "value"]).withColumn("source", F.lit("phases"))
    parsed = [df.select("path", "at", "source", "reject", "value") for df in (own, tagged, phases)]
    lines = parsed[0].unionByName(parsed[1]).unionByName(parsed[2])
    bad = lines.where("reject is not null").select("path", "at", "source", F.col("reject").alias("reason"), F.col("value").alias("text"))

    seen = lines.groupBy("path").agg(F.count(F.lit(1)).alias("_lines"))
    named = with_run_context(files.select("path")).withColumn("_end", F.regexp_extract("path", r"\.(stdout|stderr)$", 1))
    known = named.join(seen, "path", "left").join(extract_wall_metrics(stderr), "path", "left")
    times = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(f"no {text}")) for c, text in (("total_sec", "total"), ("avg_sec_per_gen", "average"))
    ]))
    timed = (F.col("_end") == "stderr") & ~((F.col("run_phase") == "accuracy") & is_ref)
    silent = F.col("_lines").isNull()
    problems = F.array_compact(F.array(
        F.when(F.col("seed").isNull(), F.struct(F.lit("file").alias("source"), F.lit("no run has this name").alias("reason"))),
        F.when(timed & (F.size(times) > 0), F.struct(F.lit("wall").alias("source"), F.array_join(times, ", ").alias("reason"))),
        F.when((F.col("_end") == "stderr") & (F.col("run_phase") == "profile") & silent,
               F.struct(F.lit("phases").alias("source"), F.lit("no phase line").alias("reason"))),
        F.when((F.col("_end") == "stdout") & (F.col("run_phase") == "accuracy") & silent,
               F.struct(F.when(is_ref, "tagged").otherwise("statistics").alias("source"), F.lit("nothing printed").alias("reason"))),
    ))
    whole = known.select("path", F.explode(problems).alias("p")).select(
        "path", F.lit(None).cast(stdout.schema["at"].dataType).alias("at"), "p.*", F.lit(None).cast("string").alias("text")
    )
    return bad.unionByName(whole).select(*REJECTS)


def collect_rejects(spark: SparkSession, folder: str, reference: str) -> DataFrame:
    """Bad lines and files of the run files below ``folder``/<phase>/<case>/, beside the tables of :func:`collect_runs`."""
    out, err = (read_lines(spark, f"{folder}/*/*/*.{end}") for end in ("stdout", "stderr"))
    return rejected_lines(out, err, read_files(spark, f"{folder}/*/*/*"), reference)
