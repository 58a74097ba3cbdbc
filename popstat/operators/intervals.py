"""Point-in-interval joins by equi-join on bins.

Points get one bin a level, intervals one row per bin they touch, and the join runs on the
bin, so it is a hash or sort-merge join of any size: the optimizer broadcasts the
intervals if they are small, and splits skewed bins if they are not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popstat.operators.groups import By, attach, dense_range
from popstat.session import cut_lineage


def _in_bins(intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    """A row per interval and bin it touches, from ``low`` to ``high``."""
    spread = intervals.withColumn("_low", low).withColumn("_more", high - low)
    numbered = dense_range(spread, "_step", "_more")
    return numbered.withColumn("_bin", F.col("_low") + F.col("_step")).drop("_low", "_more", "_step")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    position: str = "pos",
    start: str = "start",
    end: str = "end",
    how: str = "inner",
) -> DataFrame:
    """``points`` with the columns of the interval [start, end) around ``position``.

    An interval is binned at the power of two that is at least its width, so it touches
    at most two bins of its own level, and intervals that do not overlap are at most three
    to a bin whatever their widths. A point is looked up once per level that occurs, of
    which there are few; ``how`` is "inner" or "left".
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    level = F.ceil(F.log2(F.greatest(F.lit(1.0), (F.col(end) - F.col(start)).cast("double")))).cast("int")
    width = lambda l: F.pow(F.lit(2.0), l)
    binned = intervals.where(F.col(end) > F.col(start)).withColumn("_level", level)
    low, high = F.floor(F.col(start) / width("_level")), F.floor((F.col(end) - 1) / width("_level"))
    i = _in_bins(binned, low, high).alias("i")
    levels = binned.agg(F.collect_set("_level")).scalar()
    numbered = points
    if how == "left":
        numbered = cut_lineage(points.withColumn("_point", F.monotonically_increasing_id()))
    p = numbered.withColumn("_level", F.explode(levels))
    p = p.withColumn("_bin", F.floor(F.col(position) / width("_level"))).alias("p")
    match = (F.col("p._level") == F.col("i._level")) & (F.col("p._bin") == F.col("i._bin"))
    match = match & (F.col(f"p.{position}") >= F.col(f"i.{start}")) & (F.col(f"p.{position}") < F.col(f"i.{end}"))
    for name in on:
        match = match & (F.col(f"p.{name}") == F.col(f"i.{name}"))
    found = [F.col(f"i.{c}") for c in intervals.columns if c not in on]
    met = p.join(i, match)
    if how == "inner":
        return met.select(*[F.col(f"p.{c}") for c in points.columns], *found)
    return numbered.join(met.select("_point", *found), "_point", "left").drop("_point")


def cdf_lookup(draws: DataFrame, cdf: DataFrame, u: str = "u", by: By = ()) -> DataFrame:
    """The category of each draw: the first whose cdf reaches u times the total weight.

    u = 0 gives the first category and a u beyond the total the last. ``cdf`` comes
    from :func:`popstat.operators.windows.cumulative_cdf`. The unit interval is cut
    into as many bins as there are categories; for uniform draws a bin then holds
    about two categories per draw, whatever the weights are.
    """
    by = list(by)
    totals = cdf.groupBy(*by).agg(F.max("cdf").alias("_total"), F.count(F.lit(1)).alias("_n"))
    bin_of = lambda mass: F.greatest(
        F.lit(0).cast("long"),
        F.least(F.col("_n") - 1, F.floor(F.coalesce(F.try_divide(mass, F.col("_total")), F.lit(0.0)) * F.col("_n"))),
    )
    c = attach(cdf, totals, by)
    is_first, is_last = F.col("position") == 0, F.col("position") == F.col("_n") - 1
    low = F.when(is_first, F.lit(0).cast("long")).otherwise(bin_of(F.col("prev_cdf")))
    high = F.when(is_last, F.col("_n") - 1).otherwise(bin_of(F.col("cdf")))
    c = c.withColumn("_first", is_first).withColumn("_last", is_last)
    c = _in_bins(c, low, high).drop("_total", "_n").alias("c")
    d = attach(draws, totals, by).withColumn("_mass", F.col(u) * F.col("_total"))
    d = d.withColumn("_bin", bin_of(F.col("_mass"))).alias("d")
    match = F.col("d._bin") == F.col("c._bin")
    for name in by:
        match = match & (F.col(f"d.{name}") == F.col(f"c.{name}"))
    match = match & ((F.col("d._mass") > F.col("c.prev_cdf")) | F.col("c._first"))
    match = match & ((F.col("d._mass") <= F.col("c.cdf")) | F.col("c._last"))
    return d.join(c, match).select(
        *[F.col(f"d.{n}") for n in draws.columns], *[F.col(f"c.{n}") for n in cdf.columns if n not in by]
    )
