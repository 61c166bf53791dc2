"""Ranks, caps and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top(df: DataFrame, k: int, score: str, id_col: str, by: str | None = None, rank: str = "rank") -> DataFrame:
    """Rows of rank ``k`` at most, by falling score and rising id, within each ``by`` where given.

    Per group the planner ranks within each task before the shuffle, so at most ``k`` rows of
    a group leave a task.  For one list of results use a sort with a limit instead.
    """
    if by is None:
        rows = df.orderBy(F.desc(score), id_col).limit(k)
        return rows.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), id_col)))
    w = Window.partitionBy(by).orderBy(F.desc(score), id_col)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def cap(df: DataFrame, most: int, order: list[Column], *by: str) -> DataFrame:
    """At most ``most`` rows for each ``by``, the first in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 1) of at most 100 rows."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size from 1 to 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """Total rows and pages, and whether there is a page before and after."""
    pages = F.ceil(F.count("*") / size).cast("long")
    return df.agg(F.count("*").alias("total"), pages.alias("pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_previous"))


def select_rows(df: DataFrame, columns: list[str] | None = None, equal: dict[str, object] | None = None, like: dict[str, str] | None = None, order: list[tuple[str, bool]] | None = None, limit: int | None = None) -> DataFrame:
    """The select builder: conditions joined by AND; ``order`` of (column, ascending)."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v)
    for c, v in (like or {}).items():
        df = df.where(F.col(c).like(f"%{v}%"))
    if order:
        df = df.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order])
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


def select_sql(table: str, columns: list[str] | None = None, equal: dict[str, str] | None = None, like: dict[str, str] | None = None, order: list[tuple[str, bool]] | None = None, limit: int | None = None) -> str:
    """The same as SQL text; values are quoted."""
    q = lambda v: str(v).replace("'", "''")
    where = [f"{c} = '{q(v)}'" for c, v in (equal or {}).items()] + [f"{c} LIKE '%{q(v)}%'" for c, v in (like or {}).items()]
    return (
        f"SELECT {', '.join(columns) if columns else '*'} FROM {table}"
        + (f" WHERE {' AND '.join(where)}" if where else "")
        + (" ORDER BY " + ", ".join(f"{c} {'ASC' if up else 'DESC'}" for c, up in order) if order else "")
        + (f" LIMIT {limit}" if limit is not None else "")
    )
