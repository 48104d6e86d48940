"""Lists of databases and objects that lineage leaves out.

The lists are short and stated by users; their size is checked before they are broadcast.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.names import key, like_regex

DATABASES = "exclusionid long, servername string, databasename string, exclusionreason string, isactive int, createddate timestamp_ntz, createdby string"
OBJECTS = "exclusionid long, servername string, databasename string, schemaname string, objectname string, exclusionreason string, isactive int, createddate timestamp_ntz, createdby string"
#: Databases of the server itself.
SYSTEM = ("master", "tempdb", "model", "msdb")
MOST = 10_000


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _patterns(exclusions: DataFrame, pattern: str, others: list[str]) -> DataFrame:
    active = exclusions.where("isactive = 1").select(like_regex(pattern).alias("x_pattern"), *(key(c).alias(f"x_{c}") for c in others)).distinct()
    if active.limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} exclusions are active")
    return F.broadcast(active)


def database_excluded(df: DataFrame, server: str, database: str, exclusions: DataFrame) -> DataFrame:
    """``df`` without rows of a database that matches an active exclusion of its server or of all servers."""
    x = _patterns(exclusions, "databasename", ["servername"])
    return df.join(x, F.regexp_like(key(database), F.col("x_pattern")) & (F.col("x_servername").isNull() | (F.col("x_servername") == key(server))), "left_anti")


def object_excluded(df: DataFrame, columns: list[str], exclusions: DataFrame) -> DataFrame:
    """``df`` without rows whose object (server, database, schema, object) matches an active exclusion; null parts match all."""
    x = _patterns(exclusions, "objectname", ["servername", "databasename", "schemaname"])
    hit = F.regexp_like(key(columns[3]), F.col("x_pattern"))
    for mine, theirs in zip(columns[:3], ("servername", "databasename", "schemaname"), strict=True):
        hit = hit & (F.col(f"x_{theirs}").isNull() | (F.col(f"x_{theirs}") == key(mine)))
    return df.join(x, hit, "left_anti")


def listed(exclusions: DataFrame) -> DataFrame:
    """All exclusions in the order of their names."""
    return exclusions.orderBy(*(c for c in ("servername", "databasename", "schemaname", "objectname") if c in exclusions.columns))


def add(exclusions: DataFrame, now: dt.datetime, by: str, reason: str | None = None, **names: str | None) -> DataFrame:
    """The list with one more; an equal one, also in its missing parts, is refused."""
    same = None
    parts = [c for c in ("servername", "databasename", "schemaname", "objectname") if c in exclusions.columns]
    for c in parts:
        one = key(c).eqNullSafe(F.lower(F.trim(F.lit(names.get(c)).cast("string"))))
        same = one if same is None else same & one
    if not exclusions.where(same).isEmpty():
        raise ValueError(f"already excluded: {names}")
    number = exclusions.agg(F.coalesce(F.max("exclusionid"), F.lit(0))).first()[0] + 1
    fixed = {"exclusionid": number, "exclusionreason": reason, "isactive": 1, "createddate": now, "createdby": by} | {c: names.get(c) for c in parts}
    row = exclusions.sparkSession.createDataFrame([tuple(fixed[c] for c in exclusions.columns)], exclusions.schema)
    return exclusions.unionByName(row)


def add_defaults(exclusions: DataFrame, now: dt.datetime, by: str) -> DataFrame:
    """The list with the server's own databases, each unless its name is there."""
    spark = exclusions.sparkSession
    wanted = spark.createDataFrame([(n, d) for n, d in enumerate(SYSTEM, 1)], "n long, d string")
    missing = wanted.join(exclusions.select(key("databasename").alias("d")), "d", "left_anti")
    number = exclusions.agg(F.coalesce(F.max("exclusionid"), F.lit(0)).alias("last"))
    rows = missing.join(F.broadcast(number)).select(
        (F.col("last") + F.col("n")).alias("exclusionid"), F.lit(None).cast("string").alias("servername"), F.col("d").alias("databasename"), F.lit("System database").alias("exclusionreason"),
        F.lit(1).alias("isactive"), F.lit(now).cast("timestamp_ntz").alias("createddate"), F.lit(by).alias("createdby"),
    )
    return exclusions.unionByName(rows)


def remove(exclusions: DataFrame, exclusion_id: int | None = None, **names: str | None) -> DataFrame:
    """The list without the one of an id, or else without those of these very names, missing parts included."""
    if exclusion_id is not None:
        return exclusions.where(~F.col("exclusionid").eqNullSafe(F.lit(exclusion_id)))
    same = F.lit(True)
    for c in (c for c in ("servername", "databasename", "schemaname", "objectname") if c in exclusions.columns):
        same = same & key(c).eqNullSafe(F.lower(F.trim(F.lit(names.get(c)).cast("string"))))
    return exclusions.where(~same)
