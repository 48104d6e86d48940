"""Merge into a current table, with the images it replaces kept in a history table.

Inferred from the configuration: the current table is overwritten, and what a
row was before a change or a deletion is appended to the history as it stood.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.merge.scd1 import joined, scd1
from loamwork.plans.merge_plan import MergePlan


def scd4(plan: MergePlan, source: DataFrame, current: DataFrame, history: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Current and history after the merge. Columns the current table lacks are null in the history."""
    new = scd1(plan, source, current, now)
    replaced = joined(plan, source, current).where(F.col("__action").isin("update", "delete"))
    there = {c.lower(): c for c in current.columns}
    image = replaced.select(*((F.col(f"`{there[c.lower()]}`") if c.lower() in there else F.lit(None)).cast(t).alias(c) for c, t in history.dtypes))
    return new, history.unionByName(image)
