"""Profile of every column of a table, in two passes over the data.

The first counts each value of each column once (the columns are unpivoted, so
one shuffle serves them all); the second is a single aggregate for extremes and
lengths. Binary and nested columns are left out.

Defined results: an empty table gives a row for each column with zero counts
and null percentages; null is a group of its own among the most common values
and counts as unique if it stands once; trailing spaces don't count as length,
nor do they tell values apart; lengths are null for columns that aren't
strings, and whether the declared length is reached is null where none is
declared.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
PROFILED = (*NUMBERS, *TIMES, T.StringType, T.BooleanType)
MODES = 10


def _text(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(t, T.BooleanType):
        return c.cast("int").cast("string")
    return F.rtrim(c) if isinstance(t, T.StringType) else c.cast("string")


def declared_length(field: T.StructField) -> int | None:
    """Length in a varchar(n) or char(n) declaration that the table's metadata keeps."""
    m = re.fullmatch(r"(?:var)?char\((\d+)\)", field.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "") if field.metadata else "")
    return int(m[1]) if m else None


def column_profile(df: DataFrame, database: str | None = None, schema: str | None = None, table: str | None = None, lengths: dict[str, int] | None = None) -> DataFrame:
    """24 figures for each column, one row a column.

    ``lengths`` gives declared lengths that the schema doesn't carry.
    """
    spark = df.sparkSession
    fields = [(n, f) for n, f in enumerate(df.schema.fields, 1) if isinstance(f.dataType, PROFILED)]
    lengths = {f.name: declared_length(f) for _, f in fields} | (lengths or {})
    q = lambda name: F.col(f"`{name}`")
    # ties are listed in the order of the typed value, so numbers carry one along
    rank = lambda f: q(f.name).cast("double") if isinstance(f.dataType, NUMBERS) else F.lit(None).cast("double")
    cells = F.array(*(F.struct(F.lit(n).alias("n"), _text(q(f.name), f.dataType).alias("v"), rank(f).alias("r")) for n, f in fields))
    counts = df.select(F.inline(cells)).groupBy("n", "v").agg(F.count(F.lit(1)).alias("c"), F.min("r").alias("r"))
    w = Window.partitionBy("n").orderBy(F.desc("c"), "r", F.asc_nulls_first("v"))
    summary = counts.groupBy("n").agg(
        F.count("v").alias("DistinctValues"),
        F.count_if(F.col("c") == 1).alias("UniqueValues"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("NullValues"),
        F.sum("c").alias("TotalRows"),
        F.max("c").alias("top"),
    )
    # only the values that may tie for the mode are ordered
    tied = counts.join(summary.select("n", "top"), "n").where("c = top").withColumn("k", F.row_number().over(w)).where(F.col("k") <= MODES)
    modes = tied.groupBy("n").agg(F.count(F.lit(1)).alias("ties"), F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("v", F.lit("<NULL>")).alias("v")))), lambda x: x["v"])).alias("modes"))
    most = F.when(F.col("ties") == MODES, F.concat(F.lit(f"Limit ({MODES}) Reached: "), "modes")).otherwise(F.col("modes"))

    extremes = []
    for n, f in fields:
        c, t = q(f.name), f.dataType
        x = c.cast("int") if isinstance(t, T.BooleanType) else c
        size = F.length(F.rtrim(c))
        is_text = isinstance(t, T.StringType)
        none = F.lit(None)
        extremes.append(
            F.struct(
                F.lit(n).alias("n"),
                _text(F.min(x), t if not isinstance(t, T.BooleanType) else T.IntegerType()).alias("MinValue"),
                _text(F.max(x), t if not isinstance(t, T.BooleanType) else T.IntegerType()).alias("MaxValue"),
                (F.min(size) if is_text else none).cast("int").alias("MinimumLength"),
                (F.avg(size) if is_text else none).cast("decimal(10,2)").alias("AverageLength"),
                (F.max(size) if is_text else none).cast("int").alias("MaxLength"),
            )
        )
    wide = df.agg(F.array(*extremes).alias("e")).select(F.inline("e"))
    described = spark.createDataFrame(
        [(n, f.name, f.dataType.simpleString(), lengths.get(f.name), getattr(f.dataType, "precision", None), getattr(f.dataType, "scale", None)) for n, f in fields],
        "n int, ColumnName string, Type string, Length int, Precision int, Scale int",
    )
    share = lambda c: F.when(F.col("TotalRows") > 0, F.col(c) * 100.0 / F.col("TotalRows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (
        described.join(wide, "n")
        .join(summary, "n", "left")
        .join(modes, "n", "left")
        .select(
            F.col("n").alias("ColumnNumber"),
            F.lit(database).cast("string").alias("DatabaseName"),
            F.lit(schema).cast("string").alias("SchemaName"),
            F.lit(table).cast("string").alias("TableName"),
            "ColumnName",
            "Type",
            "Length",
            "Precision",
            "Scale",
            zero("TotalRows"),
            "MinValue",
            "MaxValue",
            "MinimumLength",
            "AverageLength",
            "MaxLength",
            F.when(F.col("Length").isNotNull(), (F.coalesce("MaxLength", F.lit(0)) >= F.col("Length")).cast("int")).alias("MaxLengthReached"),
            most.alias("MostCommonValue"),
            zero("top").alias("MostCommonValueAppears"),
            share("top").alias("MostCommonValuePercentage"),
            zero("DistinctValues"),
            zero("UniqueValues"),
            share("UniqueValues").alias("UniquenessPercentage"),
            zero("NullValues"),
            share("NullValues").alias("NullPercentage"),
        )
    )
