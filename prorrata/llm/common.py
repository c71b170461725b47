"""Helpers shared by the operators."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from prorrata.sources.workarea import written

_ROW_BITS = 33  # layout of monotonically_increasing_id


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc32_of(column: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes of a string."""
    return F.crc32(F.encode(column, "utf-8"))


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of an id written as text, modulo *divisor* (null ids count as the empty text)."""
    return F.pmod(crc32_of(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(divisor))


def smallest_hashes(rows: DataFrame, group: str, key: str, counts: dict, size: int) -> DataFrame:
    """About the *size* distinct keys with the smallest hashes of each group, and never more; (group, key).

    *counts* gives the rows of each group that takes part. A hash threshold leaves
    twice the sample before anything is ranked, so no task sees a whole group.
    """
    spread = 1 << 30
    limit = F.when(F.lit(False), F.lit(0.0))
    for value, count in counts.items():
        limit = limit.when(F.col(group) == F.lit(value), F.lit(2.0 * size / max(count, 1) * spread))
    hashed = F.xxhash64(key)
    few = rows.select(group, key).filter(F.pmod(hashed, F.lit(spread)) <= limit).distinct()
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.pmod(hashed, F.lit(spread)), key))
    return few.withColumn("_rank", rank).filter(F.col("_rank") <= size).drop("_rank")


def sample_window(text: Column, size: int) -> Column:
    """*text*, or of a longer one *size* characters that begin at a place given by its hash."""
    first = F.pmod(crc32_of(text), F.char_length(text) - size + 1) + 1
    return F.when(F.char_length(text) <= size, text).otherwise(text.substr(first.cast("int"), F.lit(size)))


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker.

    Functions sent by value get fresh module globals in each task, so what
    should outlive a task is kept on a module that is imported by name.
    """
    return vars(sys).setdefault("_prorrata_llm", {}).setdefault(name, {})


def shared_value(spark: SparkSession, value) -> Callable:
    """A broadcast of *value*; the function returned opens it inside a task.

    Spark pickles broadcasts by reference to their classes, which workers could
    not import; these are bytes that carry the classes along.
    """
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def opened():
        return cloudpickle.loads(packed.value)

    return opened


def number_within(rows: DataFrame, group: str, slot: str) -> DataFrame:
    """Gapless numbers from 0 inside each value of *group*, in the order of a written copy.

    A group may hold any share of all rows: rows are numbered inside each
    partition, and only the row counts of (partition, group) are summed up. The
    place of a row is written with it, so that no later reading can change it.
    """
    at = written(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    split = at.withColumn("_split", F.shiftright("_at", _ROW_BITS))
    inside = F.row_number().over(W.partitionBy(group, "_split").orderBy("_at")) - 1
    counts = split.groupBy(group, "_split").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(group).orderBy("_split")) - F.col("_rows")
    offsets = counts.select(F.col(group).alias("_group"), F.col("_split").alias("_of"), before.alias("_before"))
    joined = split.withColumn("_inside", inside).join(
        offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_split") == F.col("_of"))
    )
    return joined.withColumn(slot, F.col("_before") + F.col("_inside")).drop(
        "_at", "_split", "_inside", "_group", "_of", "_before"
    )
