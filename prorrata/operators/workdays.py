"""Business days."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def business_days(dates: DataFrame, holidays: DataFrame) -> DataFrame:
    """`Fecha` with is_business_day: neither Saturday, Sunday nor a row of *holidays* (fecha)."""
    closed = holidays.select(F.col("fecha").cast("date").alias("Fecha")).distinct().withColumn("holiday", F.lit(True))
    weekend = F.weekday("Fecha") >= 5  # Monday is 0
    return (
        dates.select("Fecha")
        .join(closed, "Fecha", "left")
        .select("Fecha", (~(weekend | F.coalesce("holiday", F.lit(False)))).alias("is_business_day"))
    )
