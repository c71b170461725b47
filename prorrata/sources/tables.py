"""Layout of the stored tables.

Facts that are read by month are partitioned by month; within a partition rows
lie together by building and unit, so the statistics of a file tell which
buildings it holds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prorrata.operators.upsert import upsert
from prorrata.schemas import BILL, PAYMENT_DETAIL, SETTLEMENT, SETTLEMENT_KEY, Table
from prorrata.sources.workarea import written

_BY_MONTH = {SETTLEMENT.name, BILL.name, PAYMENT_DETAIL.name}


def write_table(df: DataFrame, table: Table, path: str) -> None:
    """Write to a new path. Output files are balanced: a large month is split, small ones share a task."""
    if table.name not in _BY_MONTH:
        df.select(table.columns).write.mode("errorifexists").parquet(path)
        return
    _by_month(df, table).write.mode("errorifexists").partitionBy("Periodo").parquet(path)


def _by_month(df: DataFrame, table: Table) -> DataFrame:
    clustered = [c for c in ("Id_Consorcio", "NroUF") if c in table.columns]
    return df.select(table.columns).hint("rebalance", "Periodo").sortWithinPartitions("Periodo", *clustered)


def read_table(spark: SparkSession, table: Table, path: str) -> DataFrame:
    return spark.read.schema(table.schema).parquet(path).select(table.columns)


def _months_of(rows: DataFrame) -> list[dt.date]:
    """The months that *rows* touch: as many as the calendar has, whatever the number of rows."""
    return [r[0] for r in rows.select("Periodo").distinct().orderBy("Periodo").collect()]


def _in(months: list[dt.date]) -> Column:
    return F.col("Periodo").isin(months)


def _replace_months(rows: DataFrame, table: Table, path: str) -> None:
    """Rewrite the months of *rows* in a stored table. They are complete in the work area before the old files go."""
    complete = written(rows.select(table.columns), "months")
    writer = _by_month(complete, table).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("Periodo").parquet(path)


def upsert_months(spark: SparkSession, table: Table, path: str, source: DataFrame, keys: list[str]) -> list[dt.date]:
    """Upsert *source* into a table stored by month; files of other months are neither read nor written.

    *keys* contain Periodo, so a source row meets target rows of its own month
    only. Returns the months that were rewritten.
    """
    if table.name not in _BY_MONTH or "Periodo" not in keys:
        raise ValueError(f"{table.name} is not stored by month, or its months are no part of the key")
    months = _months_of(source)
    if months:
        target = read_table(spark, table, path).filter(_in(months))
        _replace_months(upsert(target, source, keys, table.name), table, path)
    return months


def replace_settlements(spark: SparkSession, table: Table, path: str, generated: DataFrame) -> list[dt.date]:
    """Delete and insert: rows of the settlements (building and month) of *generated* give way to its rows.

    Only the months of *generated* are read and written; in them, other buildings stay.
    """
    months = _months_of(generated)
    if months:
        settled = generated.select(*SETTLEMENT_KEY).distinct()
        kept = read_table(spark, table, path).filter(_in(months)).join(settled, SETTLEMENT_KEY, "left_anti")
        _replace_months(kept.unionByName(generated.select(table.columns)), table, path)
    return months
