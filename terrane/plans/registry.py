"""Queries over the driver tables: each applies operators to tables and, where SQL can say it, has an independent DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane import on_workers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        on_workers(spark)
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Registers a function of `Tables` under its own name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded, since sums of doubles depend on their order in the last place."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits)


def hist_sql(source: str, bins: int, bounds: str | None = None, by: str = "") -> str:
    """Common table expressions ending in h(by, ix, iy, frames, w, centres) for frames f(by, x, y, w)."""
    k = f"{by}, " if by else ""
    return f"""f AS ({source}),
b AS ({bounds or "SELECT min(x)::DOUBLE AS xlo, max(x)::DOUBLE AS xhi, min(y)::DOUBLE AS ylo, max(y)::DOUBLE AS yhi FROM f"}),
s AS (SELECT *, (xhi - xlo) / {bins} AS sx, (yhi - ylo) / {bins} AS sy FROM f, b WHERE x BETWEEN xlo AND xhi AND y BETWEEN ylo AND yhi),
i AS (SELECT *, floor((x - xlo) / sx) AS i0, floor((y - ylo) / sy) AS j0 FROM s),
c AS (SELECT *, least({bins - 1}, i0 - CASE WHEN x < xlo + i0 * sx THEN 1 ELSE 0 END + CASE WHEN x >= xlo + (i0 + 1) * sx THEN 1 ELSE 0 END)::INT AS ix,
             least({bins - 1}, j0 - CASE WHEN y < ylo + j0 * sy THEN 1 ELSE 0 END + CASE WHEN y >= ylo + (j0 + 1) * sy THEN 1 ELSE 0 END)::INT AS iy FROM i),
h AS (SELECT {k}ix, iy, count(*) AS frames, sum(w) AS w, any_value(xlo + (ix + 0.5) * sx) AS xc, any_value(ylo + (iy + 0.5) * sy) AS yc FROM c GROUP BY {k}ix, iy)"""


RT = "0.008314462618 * 300.0"
FRAMES = "SELECT l_quantity AS x, l_extendedprice AS y, 1.0::DOUBLE AS w FROM lineitem"
WEIGHTED = "SELECT l_quantity AS x, l_extendedprice AS y, 1 + l_tax AS w FROM lineitem"
