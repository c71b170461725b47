"""Written intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What this process writes lies under one name, so that close_work_area() can remove it.
_RUN = uuid.uuid4().hex
_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir.

    Where it is unset, a session inside one process (master local or local[n])
    gets a temporary folder that goes with the process; any other session fails.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="prorrata-work-"))
        atexit.register(shutil.rmtree, _local_folder[0], ignore_errors=True)
    return _local_folder[0]


def work_area(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/prorrata-{_RUN}"


def close_work_area(spark: SparkSession) -> None:
    """Remove everything that this process has written; results that still read it must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_area(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tasks_for(rows: int, rows_per_task: int) -> int:
    """Partitions for so many rows. A number given to `repartition` holds: Spark neither merges such partitions nor exceeds it."""
    return max(1, -(-rows // rows_per_task))


def new_folder(spark: SparkSession, name: str) -> str:
    """Place of a new table, or of a folder of tables, in the work area."""
    return f"{work_area(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write *df* once and read it back.

    Cuts the lineage and survives lost executors; unlike a row checkpoint the
    table is columnar, so each later use reads only the columns and
    partitions it needs.
    """
    path = new_folder(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
