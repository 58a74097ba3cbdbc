"""Helpers for operators that group by an optional list of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popstat.session import cut_lineage

By = Sequence[str]


def attach(df: DataFrame, summary: DataFrame, by: By, how: str = "inner") -> DataFrame:
    """Add the columns of a one-row-per-group summary.

    With groups the summary is written first, so that its size is known: a small one is
    broadcast by the optimizer and ``df`` is not shuffled by the few keys of the groups; a
    large one is joined by shuffle with skew handling. Without groups the summary is one
    row, which becomes one scalar subquery.
    """
    if by:
        return df.join(cut_lineage(summary), list(by), how)
    names = summary.columns
    row = summary.select(F.struct(*names).alias("_summary")).scalar()
    held = df.withColumn("_summary", row)
    return held.select(*df.columns, *[F.col("_summary")[n].alias(n) for n in names])


def per_group(universe: DataFrame, stats: DataFrame, by: By, defaults: dict[str, object]) -> DataFrame:
    """One row per group of ``universe``; a group without a row takes the defaults."""
    names = [c for c in stats.columns if c not in by]
    filled = [F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in names]
    if not by:
        return stats.select(*filled)
    return universe.select(*by).distinct().join(stats, list(by), "left").select(*by, *filled)


def hash_bucket(columns: Sequence[str | Column], buckets: Column | int) -> Column:
    buckets = F.lit(buckets) if isinstance(buckets, int) else buckets
    return F.pmod(F.xxhash64(*columns), buckets.cast("long"))


def dense_range(df: DataFrame, name: str, last: str, block: int = 65536) -> DataFrame:
    """One row per integer 0..last of each row, made in blocks so no row holds a huge array."""
    top = F.col(last)
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(top / block))))
    low = F.col("_block") * F.lit(block)
    return blocks.withColumn(name, F.explode(F.sequence(low, F.least(top, low + F.lit(block - 1))))).drop("_block")
