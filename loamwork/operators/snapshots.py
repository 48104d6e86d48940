"""What changed between consecutive full snapshots.

Each key's deliveries are put in the order of the snapshots' index within the
group (feed). The hash of the previous delivery tells a change; a gap in the
index tells a removal, and a later addition after it.

Defined results: the last delivered row of a key in a snapshot counts (the
largest tie-break among equals, null deliveries first); null is a value and a
null key a key; a snapshot sent again is one snapshot; skipped numbers make no
snapshot; one snapshot or none gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain(name: str, dtype: str) -> Column:
    """Value in comparable form, as text; strings without outer spaces in lower case."""
    c = F.col(name)
    return F.lower(F.trim(c)) if dtype == "string" else c.cast("string")


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """128-bit hash of the comparable forms; null differs from every text."""
    types = dict(df.dtypes)
    # the length in front makes the joined text unambiguous
    marked = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (plain(c, types[c]) for c in columns)]
    return F.unhex(F.md5(F.concat_ws("|", *marked)))


def snapshot_changes(df: DataFrame, group: str, number: str, key: str, delivered: str, tie: str, compared: list[str]) -> DataFrame:
    """(group, number, key, changekind): added, removed or changed against the group's previous snapshot.

    A hot group costs nothing: rows are reduced and ordered by group and key
    together, and the index of snapshots comes from their distinct numbers.
    """
    rows = (
        df.select(F.col(group).alias("g"), F.col(number).alias("n"), F.col(key).alias("k"), F.struct(F.col(delivered), F.col(tie)).alias("o"), row_hash(df, compared).alias("h"))
        .groupBy("g", "n", "k")
        .agg(F.max_by("h", "o").alias("h"))
    )
    by_group = Window.partitionBy("g").orderBy("n")
    index = (
        df.select(F.col(group).alias("g"), F.col(number).alias("n"))
        .distinct()
        .select(F.col("g").alias("ig"), F.col("n").alias("in_"), F.row_number().over(by_group).alias("i"), F.lead("n").over(by_group).alias("next_n"), F.lead(F.lit(1)).over(by_group).isNotNull().alias("has_next"))
    )
    placed = rows.join(index, F.expr("g <=> ig and n <=> in_")).select("g", "n", "k", "h", "i", "next_n", "has_next")
    by_key = Window.partitionBy("g", "k").orderBy("i")
    seen = placed.withColumns({"prev_i": F.lag("i").over(by_key), "prev_h": F.lag("h").over(by_key), "next_i": F.lead("i").over(by_key)})
    came = F.when((F.col("i") > 1) & (F.col("prev_i").isNull() | (F.col("prev_i") < F.col("i") - 1)), "added").when((F.col("prev_i") == F.col("i") - 1) & (F.col("prev_h") != F.col("h")), "changed")
    went = F.when(F.col("has_next") & (F.col("next_i").isNull() | (F.col("next_i") > F.col("i") + 1)), "removed")
    events = F.array(F.struct(F.col("n").alias("n"), came.alias("kind")), F.struct(F.col("next_n").alias("n"), went.alias("kind")))
    return (
        seen.select("g", "k", F.explode(F.filter(events, lambda e: e["kind"].isNotNull())).alias("e"))
        .select(F.col("g").alias(group), F.col("e.n").alias(number), F.col("k").alias(key), F.col("e.kind").alias("changekind"))
    )
