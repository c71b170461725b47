"""Facts stored in buckets by unit, or by bill.

Tables of equally many buckets by equal keys lie side by side: joins by these
keys, and sums and windows by these or more, read them without a shuffle. Joins
by more keys than the buckets' do so only where the session sets
spark.sql.requireAllClusterKeysForCoPartition to false.

A bucket is one task, so only tables whose rows of one unit are bounded by the
calendar belong here: bills (one a month), collections (one a bill and day),
units. Payments and their details do not; a hot account would fill a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from prorrata.schemas import BILL_KEY, UNIT_KEY


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a new table: as many as a shuffle of this session has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _order(columns: list[str]) -> list[str]:
    return [c for c in BILL_KEY if c in columns]


def store_buckets(
    rows: DataFrame, name: str, path: str, buckets: int | None = None, keys: Sequence[str] = UNIT_KEY
) -> DataFrame:
    """Write *rows* to a new path as the catalog's table *name*; one file a bucket, sorted by unit and month."""
    buckets = buckets or bucket_count(rows.sparkSession)
    # The shuffle hashes as the buckets do, so each task writes one file.
    writer = rows.repartition(buckets, *keys).write.mode("errorifexists").format("parquet")
    writer.bucketBy(buckets, *keys).sortBy(*_order(rows.columns)).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def open_buckets(spark: SparkSession, name: str, path: str, schema: StructType, buckets: int, keys: Sequence[str] = UNIT_KEY) -> DataFrame:
    """Make a stored table known to another catalog; *buckets* and *keys* must be those it was written with."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)})"
        f" SORTED BY ({', '.join(_order(schema.fieldNames()))}) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)


def add_to_buckets(rows: DataFrame, name: str, buckets: int, keys: Sequence[str] = UNIT_KEY) -> DataFrame:
    """Append *rows* (a new month) to a stored table; its other files stay as they are."""
    spark = rows.sparkSession
    ordered = rows.select(spark.table(name).columns).repartition(buckets, *keys)
    ordered.write.insertInto(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)
