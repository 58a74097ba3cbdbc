"""Cumulative and ordered operators, all safe against one group holding most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popstat.operators.groups import By, attach
from popstat.operators.ordered import previous_value, row_index, running_totals


def cumulative_cdf(df: DataFrame, weight: str, order: Sequence[str], by: By = ()) -> DataFrame:
    """``df`` with the running weight (cdf), the one before (prev_cdf) and a 0-based position."""
    w = F.col(weight).cast("double")
    values = {"cdf": w, "position": F.lit(1).cast("long")}
    totals = running_totals(df, values, order, by, before={"cdf": "prev_cdf"})
    return totals.withColumn("position", F.col("position") - 1)


def emission_deltas(df: DataFrame, ts: str, order: Sequence[str], by: By = ()) -> DataFrame:
    """Seconds since the previous emitted row (dt_sec) and since the first one (cumul_sec).

    The previous emission of the first row is the start, so its dt_sec is 0 here.
    """
    seconds = lambda c: c.cast("timestamp").cast("double")
    starts = df.groupBy(*by).agg(F.min(ts).alias("_start"))
    emitted = attach(previous_value(df, "_previous", ts, order, by), starts, by)
    now, start = F.col(ts), F.col("_start")
    return emitted.select(
        *df.columns,
        (seconds(now) - seconds(F.coalesce("_previous", start))).alias("dt_sec"),
        (seconds(now) - seconds(start)).alias("cumul_sec"),
    )


def coverage_violations(intervals: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """Where half-open intervals fail to tile their chromosome from 0 to its length.

    One row per violation: (chrom, start, end, violation). A gap or overlap is
    reported at the interval after it, a short end at the last interval, and
    copies of one interval once.
    """
    placed = intervals.groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("_copies"))
    lengths = chromosomes.select("chrom", "length")
    stepped = previous_value(placed, "_previous_end", "end", ["start", "end"], ["chrom"])
    stepped = stepped.join(lengths, "chrom", "left")
    rules = F.array_compact(
        F.array(
            F.when(F.col("start") != F.coalesce("_previous_end", F.lit(0)), "not contiguous"),
            F.when(F.col("_copies") > 1, "repeated"),
            F.when(F.col("end") <= F.col("start"), "empty interval"),
            F.when(F.col("end") > F.col("length"), "past the end"),
        )
    )
    inside = stepped.select("chrom", "start", "end", F.explode(rules).alias("violation"))
    ends = placed.groupBy("chrom").agg(F.max(F.struct("start", "end")).alias("_last"))
    short = (
        lengths.join(ends, "chrom", "left")
        .where(F.col("_last").isNull() | (F.col("_last.end") != F.col("length")))
        .select("chrom", "_last.start", "_last.end", F.lit("does not reach the end").alias("violation"))
    )
    return inside.unionByName(short)


def polymorphism_ids(mutations: DataFrame, by: By = ()) -> DataFrame:
    """Dense 0-based ``polymorphism_id`` per chromosome in (pos, mutation_id) order."""
    return row_index(mutations, "polymorphism_id", ["pos", "mutation_id"], [*by, "chrom"])


def import_type_ids(mutations: DataFrame, n_types: int, h: str = "h", by: By = ()) -> DataFrame:
    """A new type id per distinct (type_index, h), after the ``n_types`` declared ones.

    Numbered by first appearance in (chrom, pos, mutation_id) order.
    """
    locus = F.struct("chrom", "pos", "mutation_id")
    distinct = mutations.groupBy(*by, "type_index", F.col(h).alias("h")).agg(F.min(locus).alias("_first"))
    flat = distinct.select(
        *by, "type_index", "h",
        F.col("_first.chrom").alias("first_chrom"), F.col("_first.pos").alias("first_pos"),
        F.col("_first.mutation_id").alias("first_mutation_id"),
    )
    numbered = row_index(flat, "import_type_id", ["first_chrom", "first_pos", "first_mutation_id"], by)
    return numbered.withColumn("import_type_id", F.col("import_type_id") + F.lit(n_types + 1))


def cumulative_fixed(fixed_by_generation: DataFrame, by: By = ()) -> DataFrame:
    """Running count of newly fixed mutations and running product of their factors.

    Input columns: generation, n_new_fixed, new_fixed_factor, one row per generation.
    """
    counted = running_totals(fixed_by_generation, {"n_fixed": F.col("n_new_fixed")}, ["generation"], by)
    factor = {"fixed_fitness_factor": F.col("new_fixed_factor")}
    return running_totals(counted, factor, ["generation"], by, combine="product")
