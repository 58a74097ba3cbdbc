"""Readers of statistic rows, logs, manifests and result tables.

Each reader is a scan plus a function from DataFrame to DataFrame, so the parsing
also runs on text that is already in a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popstat.functions.text import parse_int_vector
from popstat.sources.schemas import MANIFEST, RESULT_TABLES, STAT_ROW_TEXT, VECTOR_COLUMNS, WIDE_COLUMNS, WIDE_STATS

# Patterns of the log lines and of the layout of run files
TOTAL_WALL = r"Total wall-clock:\s*([0-9.]+)\s+sec"
AVERAGE_SEC = r"Avg sec/gen:\s*([0-9.]+)"
PHASE_LINE = r"^\s+([a-zA-Z0-9_]+)\s+total=\s*([0-9.]+)\s+avg/gen=\s*([0-9.]+)\s+pct=\s*([0-9.]+)%$"
RUN_FILE = r"([^/]+)/([^/]+)/([^/_]+)_(?:([^/]+)_T([0-9]+)_)?seed([0-9]+)\.(?:stdout|stderr)$"


def _text_or_null(name: str) -> Column:
    trimmed = F.trim(F.col(name))
    return F.when(trimmed != "", trimmed)


def _bad_numbers(names: Sequence[str], kind: str) -> list[Column]:
    """Names of the text columns that hold something else than a number of this kind."""
    return [F.when(_text_or_null(c).isNotNull() & _text_or_null(c).try_cast(kind).isNull(), F.lit(c)) for c in names]


def _bad_vectors(names: Sequence[str]) -> list[Column]:
    wrong = lambda item: (F.trim(item) != "") & F.trim(item).try_cast("long").isNull()
    return [F.when(F.exists(F.split(F.trim(F.col(c)), ","), wrong), F.lit(c)) for c in names]


def _reasons(*found: Column) -> Column:
    """The names of all bad fields, NULL if there are none."""
    names = F.array_compact(F.array(*found))
    return F.when(F.size(names) > 0, F.array_join(names, ", "))


def checked_stat_rows(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Ten text columns to typed statistic rows with ``reject``: the fields that do not read, NULL if all do.

    Empty fields are NULL, vectors are arrays, a field that does not read is NULL. A row
    without a generation is bad.
    """
    vectors = [F.when(_text_or_null(c).isNotNull(), parse_int_vector(c)).alias(c) for c in VECTOR_COLUMNS]
    doubles = ("dt_sec", "cumul_sec", "scalar_value")
    no_generation = F.when(F.trim(F.coalesce("generation", F.lit(""))).try_cast("long").isNull(), F.lit("generation"))
    reject = _reasons(no_generation, *_bad_numbers(doubles, "double"), *_bad_vectors(VECTOR_COLUMNS))
    return raw.select(
        *keep,
        F.trim("generation").try_cast("long").alias("generation"),
        *[_text_or_null(c).try_cast("double").alias(c) for c in ("dt_sec", "cumul_sec")],
        _text_or_null("statistic").alias("statistic"),
        _text_or_null("metric").alias("metric"),
        _text_or_null("scalar_value").try_cast("double").alias("scalar_value"),
        *vectors,
        reject.alias("reject"),
    )


def stat_rows(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Typed statistic rows; rows with a field that does not read are left to :func:`checked_stat_rows`."""
    return checked_stat_rows(raw, keep).where("reject is null").drop("reject")


def read_stat_rows(spark: SparkSession, path: str) -> DataFrame:
    return stat_rows(spark.read.csv(path, sep="\t", header=True, schema=STAT_ROW_TEXT))


def wide_to_long(wide: DataFrame, keep: Sequence[str] = ("gen", "dt_sec", "cumul_sec")) -> DataFrame:
    """One row per report point and statistic; a statistic that was not requested is 0."""
    doubles = wide.select(*keep, *[F.col(c).cast("double").alias(name) for c, name in WIDE_COLUMNS.items()])
    long = doubles.unpivot(list(keep), list(WIDE_COLUMNS.values()), "statistic", "value")
    return long.withColumnRenamed("gen", "generation")


def read_wide_stats(spark: SparkSession, path: str) -> DataFrame:
    return wide_to_long(spark.read.csv(path, header=True, schema=WIDE_STATS))


def checked_tagged_metrics(lines: DataFrame, text: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Lines kind, name, value to (kind, name, scalar_value, vector_value, reject); other lines are dropped.

    ``reject`` is 'value' where the value does not read, else NULL.
    """
    stripped = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    parts = F.split(stripped, "\t", 3)
    three = lines.select(*keep, parts.alias("_p")).where(F.size("_p") == 3)
    part = lambda n: F.get("_p", F.lit(n))
    named = three.where(part(0).isin("scalar", "vector")).select(
        *keep, part(0).alias("kind"), part(1).alias("name"), F.trim(part(2)).alias("_value")
    )
    scalar, is_scalar = F.col("_value").try_cast("double"), F.col("kind") == "scalar"
    bad = F.when(F.when(is_scalar, scalar.isNull()).otherwise(_bad_vectors(["_value"])[0].isNotNull()), F.lit("value"))
    return named.select(
        *keep, "kind", "name", F.when(is_scalar, scalar).alias("scalar_value"),
        F.when(~is_scalar, parse_int_vector("_value")).alias("vector_value"), bad.alias("reject"),
    )


def read_tagged_metrics(lines: DataFrame, text: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(kind, name, scalar_value, vector_value) of the lines whose value reads."""
    return checked_tagged_metrics(lines, text, keep).where("reject is null").drop("reject")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of every file, empty ones too: those of Spark's own listing, no content is read."""
    found = spark.createDataFrame([(name,) for name in spark.read.text(path).inputFiles()], "path string")
    return found.select(F.regexp_replace("path", "^([^:/]+)://(?=/)", "$1:").alias("path"))  # as in the files' metadata


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and a position that ascends within it."""
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        .alias("at"),
        "value",
    )


def extract_wall_metrics(lines: DataFrame, text: str = "value", log: str = "path", at: str = "at") -> DataFrame:
    """Total seconds and average seconds per generation of each log, the first of each counting.

    A log without both has ``complete`` false: split on it for results and rejects.
    """
    def first_match(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        return F.min_by(F.when(found != "", found), F.when(found != "", F.col(at))).try_cast("double")

    found = lines.groupBy(log).agg(
        first_match(TOTAL_WALL).alias("total_sec"), first_match(AVERAGE_SEC).alias("avg_sec_per_gen")
    )
    return found.withColumn("complete", F.col("total_sec").isNotNull() & F.col("avg_sec_per_gen").isNotNull())


def checked_phase_profile(lines: DataFrame, text: str = "value", keep: Sequence[str] = ("path",)) -> DataFrame:
    """One row per phase line of a log, with ``reject``: the numbers that do not read, NULL if all do."""
    line = F.regexp_replace(F.col(text), r"\s+$", "")
    part = lambda n: F.regexp_extract(line, PHASE_LINE, n)
    numbers = {"total_sec": part(2), "avg_sec_per_gen": part(3), "pct_total": part(4)}
    bad = [F.when(x.try_cast("double").isNull(), F.lit(name)) for name, x in numbers.items()]
    return lines.where(line.rlike(PHASE_LINE)).select(
        *keep, part(1).alias("phase"), *[x.try_cast("double").alias(name) for name, x in numbers.items()], _reasons(*bad).alias("reject")
    )


def extract_phase_profile(lines: DataFrame, text: str = "value", keep: Sequence[str] = ("path",)) -> DataFrame:
    """One row per phase line of a log whose numbers read."""
    return checked_phase_profile(lines, text, keep).where("reject is null").drop("reject")


def with_run_context(df: DataFrame, path: str = "path") -> DataFrame:
    """Phase, case, simulator, builder, threads and seed from the path of a run file."""
    part = lambda n: F.regexp_extract(path, RUN_FILE, n)
    or_null = lambda n: F.when(part(n) != "", part(n))
    return df.select(
        "*", or_null(1).alias("run_phase"), or_null(2).alias("case_label"), or_null(3).alias("simulator"),
        part(4).alias("alias_builder"), F.coalesce(or_null(5).cast("long"), F.lit(1)).alias("threads"),
        or_null(6).cast("long").alias("seed"),
    )


def manifest_tables(documents: DataFrame, text: str = "value") -> dict[str, DataFrame]:
    """Model tables of JSON manifests with scenarios keyed by name."""
    parsed = documents.select(F.from_json(text, MANIFEST).alias("m"))
    s = parsed.select(F.explode("m.scenarios").alias("scenario", "s"))
    types = s.select("scenario", F.inline("s.mutation_types"))
    kinds = s.select("scenario", F.inline("s.region_types"))
    chromosomes = s.select("scenario", F.posexplode("s.chromosomes").alias("chrom", "c"))
    params = F.col("dominance.params")
    nth = lambda n: F.get(params, F.lit(n))
    pair = F.explode("weights").alias("w")
    return {
        "scenarios": s.select("scenario", "s.description", "s.N", "s.G", "s.mu", "s.rho"),
        "mutation_types": types.select(
            "scenario", F.col("name").alias("type"),
            F.col("selection.kind").alias("sel_kind"), F.col("selection.p1").alias("sel_p1"),
            F.col("selection.p2").alias("sel_p2"), F.col("selection.min_value").alias("sel_min"),
            F.col("selection.max_value").alias("sel_max"), F.col("dominance.mode").alias("dom_kind"),
            *[nth(n).alias(f"dom_p{n + 1}") for n in range(4)], F.col("dominance.distribution").alias("dom_dist"),
        ),
        "region_types": kinds.select("scenario", F.col("name").alias("region_type"), "mutation_scale"),
        "region_weights": kinds.select("scenario", F.col("name").alias("region_type"), pair).select(
            "scenario", "region_type", F.col("w")[0].alias("type"), F.col("w")[1].cast("double").alias("weight")
        ),
        "chromosomes": chromosomes.select(
            "scenario", "chrom", F.col("c.name").alias("name"), F.col("c.length").alias("length")
        ),
        "regions": chromosomes.select("scenario", "chrom", F.inline("c.regions")).withColumnRenamed(
            "region_type_name", "region_type"
        ),
        "rec_intervals": chromosomes.select("scenario", "chrom", F.inline("c.recombination_intervals")),
    }


def read_model_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return manifest_tables(spark.read.text(path, wholetext=True))


def _has_data(spark: SparkSession, path: str) -> bool:
    """True if the path exists and holds a non-empty file."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(target) and system.getContentSummary(target).getLength() > 0


def checked_result_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with header as a typed table with ``reject``: the columns whose text does not read, NULL if all do.

    A missing or empty file is an empty table, a missing column is NULL.
    """
    wanted = RESULT_TABLES[schema] if isinstance(schema, str) else schema
    if not _has_data(spark, path):
        return spark.createDataFrame([], T.StructType([*wanted.fields, T.StructField("reject", T.StringType())]))
    raw = spark.read.csv(path, header=True, multiLine=False, escape='"')
    have = set(raw.columns)
    cast = lambda f: F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
    bad = [F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f.name)) for f in wanted.fields if f.name in have]
    return raw.select(*[cast(f).alias(f.name) for f in wanted.fields], (_reasons(*bad) if bad else F.lit(None).cast("string")).alias("reject"))


def read_result_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of a typed result table all of whose columns read."""
    return checked_result_table(spark, path, schema).where("reject is null").drop("reject")
