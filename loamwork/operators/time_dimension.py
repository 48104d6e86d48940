"""Time dimension: one row a second of the day, and a sentinel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = {"Second": 1, "Minute": 60, "5Min": 300, "QuarterHour": 900, "HalfHour": 1800, "Hour": 3600}


def _clock(hour: Column, minute: Column, second: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", hour, minute, second)


def time_dimension(spark: SparkSession, sentinel: bool = True) -> DataFrame:
    """86,400 rows with keys from 1, and key -1.

    Times are text ``HH:mm:ss``. ``Interval12_Second`` shows the 24-hour time, as in the reference.
    """
    s = F.col("id").cast("int")
    hour, minute, second = F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), s % 60
    hour12 = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    whole = _clock(hour, minute, second)

    def bucket(size: int, shown: Column) -> Column:
        start = s - s % size
        return _clock(shown, (F.floor(start / 60) % 60).cast("int"), start % 60)

    rows = spark.range(86400).select(
        (F.col("id") + 1).alias("DimTime_SK"),
        whole.alias("Time"),
        second.alias("Second"),
        minute.alias("Minute"),
        hour.alias("Hour24"),
        hour12.alias("Hour12"),
        F.when(hour < 12, "AM").otherwise("PM").alias("AMPM"),
        *(bucket(n, hour).alias(f"Interval24_{b}") for b, n in BUCKETS.items()),
        *((whole if b == "Second" else bucket(n, hour12)).alias(f"Interval12_{b}") for b, n in BUCKETS.items()),
    )
    if not sentinel:
        return rows
    zero = {"DimTime_SK": F.lit(-1), "AMPM": F.lit("NA")}
    kinds = rows.dtypes
    return rows.unionByName(spark.range(1).select(*(zero.get(n, F.lit("00:00:00") if k == "string" else F.lit(0)).cast(k).alias(n) for n, k in kinds)))


def time_key(ts: Column) -> Column:
    """Key of the time dimension for a timestamp; -1 for null."""
    return F.coalesce(F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts) + 1, F.lit(-1)).cast("long")
