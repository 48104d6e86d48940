"""Long text in numbered pieces of a fixed length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTHING = "No content to print"


def text_chunks(df: DataFrame, keys: list[str], text: Column | str, size: int = 8000) -> DataFrame:
    """(keys, chunk_no, chunk): pieces from 1, each of ``size`` characters but the last.

    Null texts and texts of spaces alone give one piece that says so.
    """
    t = F.col(text) if isinstance(text, str) else text
    blank = t.isNull() | (F.length(F.rtrim(t)) == 0)
    pieces = F.when(blank, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.ceil(F.length(t) / size).cast("int")))
    out = df.select(*keys, t.alias("__t"), blank.alias("__blank"), F.explode(pieces).alias("chunk_no"))
    piece = F.when(F.col("__blank"), NOTHING).otherwise(F.col("__t").substr((F.col("chunk_no") - 1) * size + 1, F.lit(size)))
    return out.select(*keys, "chunk_no", piece.alias("chunk"))
