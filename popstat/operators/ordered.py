"""Running totals, row numbers and previous values that no single group can overload.

A window over (partition by key order by x) puts a whole key into one task. Here
the rows are cut into ordered slices of about equal size by one range shuffle, each
slice is scanned on its own, and what the earlier slices of the key contribute is
added from a summary of the keys that go on from one slice to the next, at most one a slice.
There are as many slices as keep one at about ``SLICE_ROWS``. The scanned rows are written, so
that they are scanned once. Running sums of doubles depend in their last bits on the borders of
the slices, which come from a sample.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popstat.operators.groups import By
from popstat.session import cut_lineage, temporary_tables

SLICE = "_slice"
SLICE_ROWS = 1 << 21


def _sliced(df: DataFrame, by: By, order: Sequence[str]) -> DataFrame:
    """Rows with the number of their slice; slices ascend with (by, order).

    The slice borders are drawn from a sample, so what follows from them must be written
    before it is read twice.
    """
    rows, usual = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = -(-rows // SLICE_ROWS)
    cut = df.repartitionByRange(needed, *by, *order) if needed > usual else df.repartitionByRange(*by, *order)
    return cut.withColumn(SLICE, F.spark_partition_id())


def _scanned(df: DataFrame, by: By, order: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    """Rows in slices with ``columns``, written; the rows are written before, so that they are counted, sampled and cut from one table."""
    with temporary_tables(df.sparkSession):
        return cut_lineage(_sliced(cut_lineage(df), by, order).select("*", *columns), outlive=True)


def in_slices(df: DataFrame, by: By, order: Sequence[str]) -> DataFrame:
    """Rows with the number of their slice, written, so that every later step reads the same."""
    return cut_lineage(_sliced(df, by, order))


def _with_slices(rows: DataFrame, summary: DataFrame, by: By) -> DataFrame:
    """Rows with the summary of their slice, NULL in the first slice of a group; NULL is a group like any other.

    ``summary`` has ``_later``, true but for the first slice of a group: as slices ascend, a
    border cuts at most one group, so the rest is written to be known as small.
    """
    summary = cut_lineage(summary.where("_later").drop("_later"))
    keys = [*by, SLICE]
    renamed = summary.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate(keys)})
    same = rows[SLICE] == renamed[f"_k_{len(by)}"]
    for i, k in enumerate(by):
        same = same & rows[k].eqNullSafe(renamed[f"_k_{i}"])
    return rows.join(renamed, same, "left")


def _later(by: By) -> Column:
    return (F.count(F.lit(1)).over(_earlier_slices(by)) > 0).alias("_later")


def _earlier_slices(by: By) -> Window:
    return Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def running_totals(
    df: DataFrame,
    values: Mapping[str, Column],
    order: Sequence[str],
    by: By = (),
    combine: str = "sum",
    before: Mapping[str, str] | None = None,
) -> DataFrame:
    """``df`` with the running sum or product of each named expression, own row included.

    ``order`` must identify a row within its group. ``before`` maps a name to the
    column for its value ahead of the row, which equals the value of the row
    before bit by bit: slice totals are the last running values of the slices.
    """
    fold, join, neutral = {
        "sum": (F.sum, lambda a, b: a + b, 0),
        "product": (F.product, lambda a, b: a * b, 1.0),
    }[combine]
    by, before = list(by), dict(before or {})
    staged = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    inside = Window.partitionBy(*by, SLICE).orderBy(*order)
    upto, ahead = (inside.rowsBetween(Window.unboundedPreceding, last) for last in (0, -1))
    scanned = _scanned(staged, by, order, [
        *[fold(f"_v_{n}").over(upto).alias(f"_r_{n}") for n in values],
        *[F.coalesce(fold(f"_v_{n}").over(ahead), F.lit(neutral)).alias(f"_b_{n}") for n in before],
    ])
    position = F.struct(*order)
    slice_totals = scanned.groupBy(*by, SLICE).agg(
        *[F.max_by(f"_r_{n}", position).alias(f"_t_{n}") for n in values]
    )
    earlier = _earlier_slices(by)
    offsets = slice_totals.select(*by, SLICE, _later(by), *[fold(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in values])
    offset = lambda n: F.coalesce(F.col(f"_o_{n}"), F.lit(neutral))
    return _with_slices(scanned, offsets, by).select(
        *df.columns,
        *[join(offset(n), F.col(f"_r_{n}")).alias(n) for n in values],
        *[join(offset(n), F.col(f"_b_{n}")).alias(name) for n, name in before.items()],
    )


def row_index(df: DataFrame, name: str, order: Sequence[str], by: By = ()) -> DataFrame:
    """``df`` with a dense 0-based number in the given order."""
    numbered = running_totals(df, {name: F.lit(1).cast("long")}, order, by)
    return numbered.withColumn(name, F.col(name) - 1)


def previous_value(df: DataFrame, name: str, value: str, order: Sequence[str], by: By = ()) -> DataFrame:
    """``df`` with ``value`` of the row before, NULL at the first row of a group."""
    by = list(by)
    inside = Window.partitionBy(*by, SLICE).orderBy(*order)
    scanned = _scanned(df, by, order, [F.lag(value).over(inside).alias("_lag"), F.row_number().over(inside).alias("_row")])
    last = scanned.groupBy(*by, SLICE).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select(
        *by, SLICE, _later(by), F.last("_last").over(_earlier_slices(by)).alias("_carried")
    )
    return _with_slices(scanned, carried, by).select(
        *df.columns, F.when(F.col("_row") == 1, F.col("_carried")).otherwise(F.col("_lag")).alias(name)
    )
