"""Writers of statistic rows, result tables and population snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popstat.functions.scalars import hap_index, individual_of, recover_dominance
from popstat.functions.text import export_number, format_int_vector, format_scalar
from popstat.operators.filters import segregating
from popstat.operators.results import union_results
from popstat.operators.statistics import site_counts
from popstat.operators.windows import import_type_ids, polymorphism_ids
from popstat.session import cut_lineage
from popstat.sources.schemas import COUNT_STATISTICS, STAT_ROW_COLUMNS, VECTOR_COLUMNS


def format_stat_rows(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The ten columns as text: scalars with ten decimals, counts as integers, vectors comma-joined."""
    count = F.col("scalar_value").cast("long").cast("string")
    scalar = F.when(F.col("statistic").isin(*COUNT_STATISTICS), count).otherwise(format_scalar("scalar_value"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = {
        "generation": F.col("generation").cast("string"),
        "dt_sec": F.format_string("%.6f", F.coalesce("dt_sec", F.lit(0.0))),
        "cumul_sec": F.format_string("%.6f", F.coalesce("cumul_sec", F.lit(0.0))),
        "statistic": F.col("statistic"),
        "metric": blank(F.col("metric")),
        "scalar_value": F.when(F.col("scalar_value").isNull(), "").otherwise(scalar),
    } | {c: blank(format_int_vector(c)) for c in VECTOR_COLUMNS}
    return rows.select(*keep, *[text[c].alias(c) for c in STAT_ROW_COLUMNS])


def write_stat_rows(rows: DataFrame, path: str) -> None:
    """Tab-separated files, ordered by generation, statistic and metric."""
    ordered = rows.orderBy("generation", "statistic", "metric")
    format_stat_rows(ordered).write.csv(path, sep="\t", header=True, emptyValue="")


def write_result_table(dfs: Sequence[DataFrame], path: str) -> None:
    """CSV under the union of all columns in first-seen order; absent values are empty."""
    union_results(dfs).write.csv(path, header=True, emptyValue="", nullValue="", escape='"')


def _line(*parts) -> Column:
    return F.concat_ws(" ", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def exported_effects(mutations: DataFrame) -> DataFrame:
    """``mutations`` with s and h as their stored effects say, and ``used_fallback``.

    Needs hom_factor, het_factor, dom_kind and dom_p1..dom_p4, and ``dom_mean``, the mean of the
    dominance distribution, which stands for h where a mutation has no selection: s is the
    homozygous factor less one, and h follows from the rule of the type or from both factors.
    """
    s = F.col("hom_factor") - F.lit(1.0)
    parameters = [f"dom_p{i}" for i in range(1, 5)]
    recovered = recover_dominance("dom_kind", *parameters, s, "het_factor", "dom_mean")
    kept = [c for c in mutations.columns if c not in ("s", "h", "used_fallback")]
    return mutations.select(*kept, s.alias("s"), recovered.alias("_r")).select(*kept, "s", "_r.h", "_r.used_fallback")


def population_lines(
    carriers: DataFrame,
    mutations: DataFrame,
    haplotypes: DataFrame,
    chromosomes: DataFrame,
    n_types: int,
    generation: int,
    piece: int = 65536,
) -> DataFrame:
    """Lines (chrom, section, number, line) of the text snapshot of one population.

    ``mutations`` needs chrom, pos, type_index, dom_kind, s, h and origin_generation, with s
    and h for example from :func:`exported_effects`. Only segregating mutations are written;
    they are numbered once, and written before their own and the haplotypes' lines are made.
    Types that draw h are numbered by the h that is printed. The format wants one line per haplotype
    and chromosome; it is put together from ordered pieces, so no task gathers more
    than one line.
    """
    sites = segregating(site_counts(carriers, haplotypes)).join(mutations, "mutation_id")
    numbered = cut_lineage(polymorphism_ids(sites).withColumn("_s", export_number("s")).withColumn("_h", export_number("h")))
    own_type = F.col("dom_kind").isin("distributed", "linear")
    imported = import_type_ids(numbered.where(own_type), n_types, "_h").select("type_index", F.col("h").alias("_h"), "import_type_id")
    typed = numbered.join(imported, ["type_index", "_h"], "left").withColumn(
        "type_id", F.when(own_type, F.col("import_type_id")).otherwise(F.col("type_index") + 1)
    )
    mutation_lines = typed.select(
        "chrom", F.lit(1).alias("section"), F.col("polymorphism_id").alias("number"),
        _line(
            F.col("polymorphism_id").cast("string"), F.col("mutation_id").cast("string"),
            F.concat(F.lit("m"), F.col("type_id").cast("string")), F.col("pos").cast("string"),
            F.col("_s"), F.col("_h"), "p1", F.col("origin_generation").cast("string"),
            F.col("copies").cast("string"),
        ).alias("line"),
    )
    dense = numbered.select("mutation_id", "chrom", "polymorphism_id")
    held = carriers.select("haplotype_id", "mutation_id").join(dense, "mutation_id")
    text = F.array_join(F.array_sort(F.collect_list("polymorphism_id")).cast("array<string>"), " ")
    pieces = held.groupBy("chrom", "haplotype_id", F.floor(F.col("polymorphism_id") / piece).alias("_piece")).agg(
        text.alias("_text")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_text"))), lambda p: p["_text"])
    lists = pieces.groupBy("chrom", "haplotype_id").agg(F.array_join(ordered, " ").alias("_ids"))
    chroms = chromosomes.agg(F.collect_set("chrom")).scalar()
    every = haplotypes.select("haplotype_id").withColumn("chrom", F.explode(chroms))
    person = F.concat(F.lit("p1:i"), individual_of("haplotype_id").cast("string"))
    haplotype_lines = every.join(lists, ["chrom", "haplotype_id"], "left").select(
        "chrom", F.lit(3).alias("section"), F.col("haplotype_id").alias("number"),
        _line(person, F.col("_ids")).alias("line"),
    )
    title = lambda section, number, line: F.struct(
        F.lit(section).alias("section"), F.lit(number).cast("long").alias("number"), line.alias("line")
    )
    chromosome = _line(
        "Chromosome:", F.col("chrom").cast("string"), "A", (F.col("chrom") + 1).cast("string"),
        (F.col("length") - 1).cast("string"), F.format_string('"%d"', F.col("chrom") + 1),
    )
    titles = chromosomes.select(
        "chrom",
        F.inline(
            F.array(
                title(0, 0, chromosome), title(0, 1, F.lit("Mutations:")), title(2, 0, F.lit("Haplosomes:")),
            )
        ),
    )
    people = haplotypes.where(hap_index("haplotype_id") == 0).select(
        F.lit(-1).alias("chrom"), F.lit(1).alias("section"), individual_of("haplotype_id").alias("number"),
        _line(person, "H").alias("line"),
    )
    gen = str(generation)
    head = haplotypes.agg(F.count_distinct(individual_of("haplotype_id")).alias("_n")).select(
        F.lit(-1).alias("chrom"), F.lit(0).alias("section"),
        F.posexplode(
            F.array(
                _line("#OUT:", gen, gen, "A"), F.lit("Version: 8"), F.lit("Flags:"), F.lit("Populations:"),
                _line("p1", F.col("_n").cast("string"), "H"), F.lit("Individuals:"),
            )
        ).alias("number", "line"),
    )
    parts = [head, people, titles, mutation_lines, haplotype_lines]
    typed_parts = [
        p.select(F.col("chrom").cast("int").alias("chrom"), F.col("section").cast("int").alias("section"),
                 F.col("number").cast("long").alias("number"), "line")
        for p in parts
    ]
    return union_results(typed_parts)


def export_population(lines: DataFrame, path: str) -> None:
    """Write the lines of :func:`population_lines` in order; the files of the folder, read by name, are the text."""
    lines.orderBy("chrom", "section", "number").select("line").write.text(path)
