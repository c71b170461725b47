"""Keyed insert-and-update over immutable tables.

The result is a new table. Write it to a new path and let readers switch; a
path must not be overwritten while it is being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from prorrata.sources.workarea import written

_ROWS_PER_PARTITION_BITS = 33  # layout of monotonically_increasing_id


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def unique_source(source: DataFrame, keys: list[str], name: str) -> DataFrame:
    """*source* as it is; the job fails, naming the key, if a key occurs twice.

    The check is part of the plan: rows are numbered on the shuffle and the
    sort by key that the join that follows needs anyway.
    """
    message = F.concat(F.lit(f"{name}: more than one source row for "), F.to_json(F.struct(*keys)))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*keys))
    once = F.when(F.col("_place") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return source.withColumn("_place", place).filter(once).select(source.columns)


def assign_ids(rows: DataFrame, id_column: str, order: list[str], after: int) -> DataFrame:
    """Consecutive ids from after + 1 in the order of the (unique) *order* columns.

    Rows are range-partitioned and numbered inside each partition; only the row
    counts of the partitions are summed up in one place.
    """
    numbered = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright("_at", _ROWS_PER_PARTITION_BITS).alias("_part")
    counts = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("_count"))
    before = F.sum("_count").over(W.orderBy("_part")) - F.col("_count")
    offsets = counts.select("_part", before.alias("_before"))
    in_part = F.col("_at").bitwiseAND(F.lit((1 << _ROWS_PER_PARTITION_BITS) - 1))
    return (
        numbered.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(id_column, F.lit(after) + F.col("_before") + in_part + 1)
        .drop("_at", "_part", "_before")
    )


def _new_rows(target: DataFrame, source: DataFrame, keys: list[str], id_column: str | None) -> DataFrame:
    new = source.join(target.select(*keys), keys, "left_anti")
    if id_column is not None:
        last = target.agg(F.max(id_column)).first()[0] or 0
        new = assign_ids(new, id_column, keys, last)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in target.schema if f.name not in new.columns}
    return new.withColumns(missing).select(target.columns) if missing else new.select(target.columns)


def insert_missing(
    target: DataFrame, source: DataFrame, keys: list[str], name: str, id_column: str | None = None
) -> DataFrame:
    """*target* plus the source rows whose key it does not have."""
    return target.unionByName(_new_rows(target, unique_source(source, keys, name), keys, id_column))


def upsert(
    target: DataFrame, source: DataFrame, keys: list[str], name: str, id_column: str | None = None
) -> DataFrame:
    """*target* with the source rows of known keys updated and the others inserted.

    All source columns are overwritten, also with NULL; columns that only the
    target has keep their value.
    """
    source = unique_source(source, keys, name)
    updated = [c for c in source.columns if c not in keys]
    renamed = source.withColumnsRenamed({c: f"_new_{c}" for c in updated}).withColumn("_in_source", F.lit(True))

    def merged(column: str):
        if column not in updated:
            return F.col(column)
        fresh = F.col(f"_new_{column}").cast(target.schema[column].dataType)
        return F.when(F.col("_in_source"), fresh).otherwise(F.col(column)).alias(column)

    columns = [merged(c) for c in target.columns]
    if id_column is None:
        return target.join(renamed, keys, "full").select(columns)
    # One join tells updates from new rows; the new ones are numbered from their own part of the written result.
    both = target.withColumn("_in_target", F.lit(True)).join(renamed, keys, "full")
    both = written(both.select(*columns, F.col("_in_target").isNull().alias("_is_new")), "merged", ("_is_new",))
    known = both.filter(~F.col("_is_new")).select(target.columns)
    new = both.filter("_is_new").select([c for c in target.columns if c != id_column])
    last = known.agg(F.max(id_column)).first()[0] or 0
    return known.unionByName(assign_ids(new, id_column, keys, last).select(target.columns))
