"""Registry of queries with their SQL, and the SQL views the SQL is written on."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popstat.session import ship_package
from workload.sql_views import SQL_VIEWS
from workload.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(views)`` under ``name``; its SQL may use any view of SQL_VIEWS."""

    def register(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return build(Views(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql)
        return build

    return register


def with_views(body: str) -> str:
    """``body`` behind a WITH list of the views it names, directly or through other views."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in ordered and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(SQL_VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    views = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in ordered)
    return f"WITH {views}\n{body}" if ordered else body


def r6(column: str | Column, name: str | None = None) -> Column:
    """A double rounded for comparison: sums differ in their last digits by order."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


def r9(column: str | Column, name: str | None = None) -> Column:
    """Nine decimals, for quotients of amounts in cents: they end in a 5 too often at six."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 9).alias(name or column)


def big(column: str | Column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("long").alias(name or column)
