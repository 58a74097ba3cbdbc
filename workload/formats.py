"""Queries of readers and writers, on text that Spark makes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from popstat.operators.checks import STATISTICS
from popstat.session import scratch_path
from popstat.sources import readers as rd
from popstat.sources import writers as wr
from popstat.sources.schemas import WIDE_COLUMNS
from workload.registry import big, query, r6
from workload.sql_views import BUILDERS as SQL_BUILDERS
from workload.sql_views import STATS
from workload.views import BUILDERS, Views, nth

_KIND = f"{STATS}[event_id % 12 + 1]"


def _typed_rows(v: Views):
    """Statistic rows made from events."""
    kind = nth(STATISTICS, F.col("event_id") % 12)
    histogram, spectrum = kind == "mutation_histogram", kind == "site_frequency_spectrum"
    pair = F.array(F.col("user_id"), F.col("event_id"))
    count = kind.isin("n_seg", "n_fixed", "genome_words")
    scalar = F.when(count, F.col("user_id").cast("double")).otherwise(F.col("value") / 8)
    return v.table("events").select(
        F.col("event_id").alias("generation"), F.col("value").alias("dt_sec"), (F.col("value") * 2).alias("cumul_sec"),
        kind.alias("statistic"), F.lit("jaccard").alias("metric"),
        F.when(~histogram & ~spectrum, scalar).alias("scalar_value"),
        F.when(histogram, pair).alias("by_type"), F.when(histogram, F.array(F.col("user_id"))).alias("by_chromosome"),
        F.when(spectrum, pair).alias("unfolded_sfs"), F.when(spectrum, F.array(F.col("event_id"))).alias("folded_sfs"),
    )


_VECTORS_SQL = f"""CASE WHEN {_KIND} = 'mutation_histogram' THEN concat(user_id, ',', event_id) ELSE '' END AS by_type,
CASE WHEN {_KIND} = 'mutation_histogram' THEN CAST(user_id AS VARCHAR) ELSE '' END AS by_chromosome,
CASE WHEN {_KIND} = 'site_frequency_spectrum' THEN concat(user_id, ',', event_id) ELSE '' END AS unfolded_sfs,
CASE WHEN {_KIND} = 'site_frequency_spectrum' THEN CAST(event_id AS VARCHAR) ELSE '' END AS folded_sfs"""


@query("write_stat_rows", f"""SELECT CAST(event_id AS VARCHAR) AS generation, printf('%.6f', value) AS dt_sec,
printf('%.6f', value * 2) AS cumul_sec, {_KIND} AS statistic, 'jaccard' AS metric,
CASE WHEN {_KIND} IN ('n_seg', 'n_fixed', 'genome_words') THEN CAST(user_id AS VARCHAR)
WHEN {_KIND} IN ('mutation_histogram', 'site_frequency_spectrum') THEN '' ELSE printf('%.10f', value / 8) END
AS scalar_value, {_VECTORS_SQL} FROM events""")
def _(v):
    return wr.format_stat_rows(_typed_rows(v))


@query("read_stat_rows", f"""SELECT event_id AS generation, round(value, 6) AS dt_sec, {_KIND} AS statistic,
CASE WHEN {_KIND} IN ('n_seg', 'n_fixed', 'genome_words') THEN CAST(user_id AS DOUBLE)
WHEN {_KIND} NOT IN ('mutation_histogram', 'site_frequency_spectrum') THEN round(value / 8, 6) END AS scalar_value,
{_VECTORS_SQL} FROM events""")
def _(v):
    """Written as tab-separated files and read back."""
    path = scratch_path(v.spark, "stat-rows")
    wr.write_stat_rows(_typed_rows(v), path)
    rows = rd.read_stat_rows(v.spark, path)
    text = [F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("")).alias(c)
            for c in ("by_type", "by_chromosome", "unfolded_sfs", "folded_sfs")]
    return rows.select("generation", r6("dt_sec"), "statistic", r6("scalar_value"), *text)


_WIDE = {name: k for k, name in enumerate(WIDE_COLUMNS.values(), 1)}
_WIDE_SQL = ", ".join(f"round(value * {k}, 6)" for k in _WIDE.values())
_WIDE_NAMES = ", ".join(f"'{name}'" for name in _WIDE)


@query("read_wide_stats", f"""SELECT event_id AS generation, unnest([{_WIDE_NAMES}]) AS statistic,
unnest([{_WIDE_SQL}]) AS value FROM events""")
def _(v):
    wide = v.table("events").select(
        F.col("event_id").alias("gen"), F.lit(0.0).alias("dt_sec"), F.lit(0.0).alias("cumul_sec"),
        *[(F.col("value") * k).alias(c) for k, c in enumerate(WIDE_COLUMNS, 1)],
    )
    return rd.wide_to_long(wide).select("generation", "statistic", r6("value"))


@query("read_tagged_metrics", """SELECT event_id, CASE event_type WHEN 'click' THEN 'scalar' ELSE 'vector' END AS kind,
event_type AS name, CASE event_type WHEN 'click' THEN round(value, 6) END AS scalar_value,
CASE event_type WHEN 'view' THEN concat(user_id, ',', event_id) END AS vector FROM events
WHERE event_type IN ('click', 'view')""")
def _(v):
    """Clicks are written as scalars, views as vectors, errors and the rest as lines to drop."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit("scalar\t"), kind, F.lit("\t"), F.col("value").cast("string")))
        .when(kind == "view", F.concat(F.lit("  vector\t"), kind, F.lit("\t"), F.concat_ws(",", "user_id", "event_id")))
        .when(kind == "error", F.concat(F.lit("note\t"), kind, F.lit("\ttext\twith tabs")))
        .otherwise(F.lit("scalar without tabs"))
    )
    lines = v.table("events").select("event_id", text.alias("value"))
    parsed = rd.read_tagged_metrics(lines, keep=["event_id"])
    return parsed.select(
        "event_id", "kind", "name", r6("scalar_value"),
        F.array_join(F.col("vector_value").cast("array<string>"), ",").alias("vector"),
    )


def _log_lines(v: Views):
    """Log lines of a run per event: the phase lines of a profile between two summary lines."""
    phase = F.format_string(
        "  %-26s total=%10.6f  avg/gen=%10.6f  pct=%6.2f%%", "event_type", F.col("value"), F.col("value") / 8, F.lit(12.5)
    )
    total = F.format_string("Total wall-clock: %.6f sec", F.col("value") * 2)
    average = F.when(F.col("event_id") % 3 == 0, F.lit("no average")).otherwise(
        F.format_string("Avg sec/gen: %.6f", F.col("value") / 4)
    )
    lines = F.array(total, average, F.lit("Profiler summary across 8 generations:"), phase)
    return v.table("events").select(F.col("event_id").alias("path"), F.posexplode(lines).alias("at", "value"))


@query("extract_wall_metrics", """SELECT event_id AS log, round(value * 2, 6) AS total_sec,
CASE WHEN event_id % 3 <> 0 THEN round(CAST(printf('%.6f', value / 4) AS DOUBLE), 6) END AS avg_sec_per_gen,
event_id % 3 <> 0 AS complete FROM events""")
def _(v):
    return rd.extract_wall_metrics(_log_lines(v)).select(
        F.col("path").alias("log"), r6("total_sec"), r6("avg_sec_per_gen"), "complete"
    )


@query("extract_phase_profile", """SELECT event_id AS log, event_type AS phase, round(value, 6) AS total_sec,
round(CAST(printf('%.6f', value / 8) AS DOUBLE), 6) AS avg_sec_per_gen, CAST(12.5 AS DOUBLE) AS pct_total FROM events""")
def _(v):
    return rd.extract_phase_profile(_log_lines(v)).select(
        F.col("path").alias("log"), "phase", r6("total_sec"), r6("avg_sec_per_gen"), "pct_total"
    )


@query("with_run_context", f"""SELECT event_id AS seed, 'speed' AS run_phase, event_type AS case_label,
CASE WHEN event_id % 4 = 0 THEN 'ref' ELSE 'cand' END AS simulator,
CASE WHEN event_id % 4 = 0 THEN '' ELSE {SQL_BUILDERS}[user_id % 3 + 1] END AS alias_builder,
CASE WHEN event_id % 4 = 0 THEN 1 ELSE user_id % 8 + 1 END AS threads FROM events""")
def _(v):
    head = F.concat(F.lit("file:/results/raw/speed/"), "event_type", F.lit("/"))
    seed = F.concat(F.lit("_seed"), F.col("event_id").cast("string"))
    builder = nth(BUILDERS, F.col("user_id") % 3)
    own = F.concat(head, F.lit("cand_"), builder, F.lit("_T"), (F.col("user_id") % 8 + 1).cast("string"), seed, F.lit(".stderr"))
    path = F.when(F.col("event_id") % 4 == 0, F.concat(head, F.lit("ref"), seed, F.lit(".stdout"))).otherwise(own)
    return rd.with_run_context(v.table("events").select(path.alias("path"))).drop("path")


def _manifests(v: Views):
    """A JSON manifest per part with one scenario."""
    name = F.concat(F.lit("part"), F.col("p_partkey").cast("string"))
    size = F.col("p_size").cast("long")
    field = lambda **kw: F.struct(*[c.alias(n) for n, c in kw.items()])
    dist = lambda kind, p1, p2: field(
        kind=F.lit(kind), p1=p1, p2=p2, min_value=F.lit(-1.0), max_value=F.lit(1.0))
    selection = dist("gamma", F.col("p_retailprice"), F.lit(0.3))
    types = F.array(
        field(name=F.lit("neutral"), selection=dist("constant", F.lit(0.0), F.lit(0.0)),
              dominance=field(mode=F.lit("additive"), params=F.array().cast("array<double>"))),
        field(name=F.col("p_type"), selection=selection,
              dominance=field(mode=F.lit("fixed"), params=F.array(size.cast("double") / 100))),
    )
    weights = F.array(F.array(F.lit("neutral"), F.lit("1.5")), F.array(F.col("p_type"), size.cast("string")))
    regions = F.array(
        field(region_type_name=F.col("p_brand"), start=F.lit(0).cast("long"), end=size),
        field(region_type_name=F.col("p_brand"), start=size, end=size * 2),
    )
    crossing = F.array(field(start=F.lit(0).cast("long"), end=size * 2, rate_scale=F.lit(0.5)))
    scenario = field(
        name=name, description=F.col("p_name"), N=size, G=size + 1, mu=F.lit(1e-3), rho=F.lit(0.5), mutation_types=types,
        region_types=F.array(field(name=F.col("p_brand"), mutation_scale=F.lit(2.0), weights=weights)),
        chromosomes=F.array(field(name=F.lit("chr1"), length=size * 2, recombination_intervals=crossing, regions=regions)),
    )
    return v.table("part").select(F.to_json(F.struct(F.create_map(name, scenario).alias("scenarios"))).alias("value"))


@query("manifest_regions", """SELECT concat('part', p_partkey) AS scenario, 0 AS chrom, p_brand AS region_type,
CAST(unnest([0, p_size]) AS BIGINT) AS "start", CAST(unnest([p_size, p_size * 2]) AS BIGINT) AS "end" FROM part""")
def _(v):
    regions = rd.manifest_tables(_manifests(v))["regions"]
    return regions.select("scenario", "chrom", "region_type", "start", "end")


@query("manifest_types", """SELECT concat('part', p_partkey) AS scenario, unnest(['neutral', p_type]) AS type,
unnest(['constant', 'gamma']) AS sel_kind, round(unnest([0, p_retailprice]), 6) AS sel_p1,
unnest(['additive', 'fixed']) AS dom_kind, round(unnest([NULL, p_size / CAST(100 AS DOUBLE)]), 6) AS dom_p1 FROM part""")
def _(v):
    return rd.manifest_tables(_manifests(v))["mutation_types"].select(
        "scenario", "type", "sel_kind", r6("sel_p1"), "dom_kind", r6("dom_p1")
    )


@query("manifest_weights", """SELECT concat('part', p_partkey) AS scenario, p_brand AS region_type,
unnest(['neutral', p_type]) AS type, unnest([1.5, CAST(p_size AS DOUBLE)]) AS weight FROM part""")
def _(v):
    """Read from files, a whole document per row."""
    path = scratch_path(v.spark, "manifests")
    _manifests(v).write.text(path)
    lines = v.spark.read.text(path)
    return rd.manifest_tables(lines)["region_weights"].select("scenario", "region_type", "type", "weight")


@query("result_table_roundtrip", """SELECT case_label, simulator, CAST(threads AS BIGINT) AS threads,
CAST(NULL AS VARCHAR) AS phase, round(total_sec, 6) AS total_sec FROM runs
UNION ALL SELECT case_label, NULL, threads, phase, round(total_sec, 6) FROM phases""")
def _(v):
    """Two tables with different columns under one header, written and read back."""
    path = scratch_path(v.spark, "results")
    wr.write_result_table([
        v.runs.select("case_label", "simulator", "threads", "total_sec"),
        v.phases.select("case_label", "threads", "phase", "total_sec"),
    ], path)
    schema = T.StructType.fromDDL("case_label STRING, simulator STRING, threads BIGINT, phase STRING, total_sec DOUBLE")
    return rd.read_result_table(v.spark, path, schema).withColumn("total_sec", F.round("total_sec", 6))


_NUMBERED = """(SELECT m.mutation_id, m.chrom, m.pos, m.type_index, m.dom_kind, printf('%.17g', m.hom_factor - 1) AS s,
  printf('%.17g', CAST(0 AS DOUBLE) + CASE m.dom_kind WHEN 'distributed' THEN (m.het_factor - 1) / (m.hom_factor - 1)
    WHEN 'linear' THEN CAST(0.45 AS DOUBLE) + CAST(-350 AS DOUBLE) * (m.hom_factor - 1) ELSE m.h END) AS h, m.origin_generation,
  k.copies, row_number() OVER (PARTITION BY m.chrom ORDER BY m.pos, m.mutation_id) - 1 AS dense
  FROM mutations m JOIN (SELECT mutation_id, count(*) AS copies FROM carriers GROUP BY 1
    HAVING count(*) < (SELECT n FROM n_haplotypes)) k ON k.mutation_id = m.mutation_id)"""
_IMPORTED = f"""(SELECT type_index, h, row_number() OVER (ORDER BY chrom, pos, mutation_id) + 6 AS import_type_id FROM (
  SELECT *, row_number() OVER (PARTITION BY type_index, h ORDER BY chrom, pos, mutation_id) AS rn FROM {_NUMBERED}
  WHERE dom_kind IN ('distributed', 'linear')) WHERE rn = 1)"""


@query("export_population", f"""
SELECT -1 AS chrom, 0 AS section, unnest(range(6)) AS number, unnest(['#OUT: 7 7 A', 'Version: 8', 'Flags:',
  'Populations:', concat('p1 ', count(DISTINCT haplotype_id // 2), ' H'), 'Individuals:']) AS line FROM haplotypes
UNION ALL SELECT DISTINCT -1, 1, haplotype_id // 2, concat('p1:i', haplotype_id // 2, ' H') FROM haplotypes
UNION ALL SELECT chrom, 0, 0, concat('Chromosome: ', chrom, ' A ', chrom + 1, ' ', length - 1, ' "', chrom + 1, '"')
  FROM chromosomes
UNION ALL SELECT chrom, 0, 1, 'Mutations:' FROM chromosomes
UNION ALL SELECT chrom, 2, 0, 'Haplosomes:' FROM chromosomes
UNION ALL SELECT n.chrom, 1, n.dense, concat(n.dense, ' ', n.mutation_id, ' m', coalesce(i.import_type_id,
  n.type_index + 1), ' ', n.pos, ' ', n.s, ' ', n.h, ' p1 ', n.origin_generation, ' ',
  n.copies) FROM {_NUMBERED} n LEFT JOIN {_IMPORTED} i ON i.type_index = n.type_index AND i.h = n.h
UNION ALL SELECT u.chrom, 3, h.haplotype_id, concat('p1:i', h.haplotype_id // 2, coalesce(' ' || l.ids, ''))
  FROM haplotypes h JOIN chromosomes u ON true
  LEFT JOIN (SELECT c.haplotype_id, n.chrom, string_agg(CAST(n.dense AS VARCHAR), ' ' ORDER BY n.dense) AS ids
    FROM carriers c JOIN {_NUMBERED} n ON n.mutation_id = c.mutation_id GROUP BY 1, 2) l
  ON l.haplotype_id = h.haplotype_id AND l.chrom = u.chrom""")
def _(v):
    """Numbers with all their digits; s and h come from the stored effects."""
    carriers, haplotypes = v.everyone
    linear = F.col("dom_kind") == "linear"
    rules = {"dom_p1": F.when(linear, 0.45).otherwise(F.col("h")), "dom_p2": F.lit(-350.0), "dom_p3": F.lit(-10.0),
             "dom_p4": F.lit(10.0), "dom_mean": F.lit(0.5)}
    stored = wr.exported_effects(v.mutations.withColumns(rules))
    lines = wr.population_lines(carriers, stored, haplotypes, v.chromosomes, 6, 7)
    return lines.select("chrom", "section", big("number"), "line")
