"""Merge that overwrites: one full outer join gives the target's new state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.plans.merge_plan import MergePlan, differs, require_unique, same_key, source_side


def joined(plan: MergePlan, source: DataFrame, target: DataFrame) -> DataFrame:
    """Both sides with ``__action``: update, keep, insert, delete or leave."""
    both = source_side(plan, source).join(target.withColumn("__in_target", F.lit(1)), same_key(plan), "full_outer")
    missing = "delete" if plan.config.delete_if_not_matched else "leave"
    action = F.when(F.col("__in_target").isNull(), "insert").when(F.col("__in_source").isNull(), missing).when(differs(plan), "update").otherwise("keep")
    return both.withColumn("__action", action)


def scd1(plan: MergePlan, source: DataFrame, target: DataFrame, now: dt.datetime, check: bool = True) -> DataFrame:
    """The target after the merge, in its own columns.

    Differing rows take the source's values and the time of change; new rows are added;
    rows missing from the source stay or go as configured. Null keys match nothing.
    Columns the source lacks stay on update and are null on insert.
    """
    if check:
        require_unique(plan, source)
    moment = F.lit(now).cast("timestamp_ntz")
    rows = joined(plan, source, target).where("__action <> 'delete'")
    types = dict(target.dtypes)
    set_ = F.col("__action").isin("insert", "update")
    out = []
    for c in plan.target_columns:
        old = F.col(f"`{c}`")
        if c == plan.kept.get("create"):
            new = F.when(F.col("__action") == "insert", moment).otherwise(old)
        elif c == plan.kept.get("modified"):
            new = F.when(set_, moment).otherwise(old)
        elif c in plan.keys:
            new = F.when(F.col("__action") == "insert", F.col(f"__s_{c}")).otherwise(old)
        elif c in plan.compared:
            new = F.when(set_, F.col(f"__s_{c}")).otherwise(old)
        else:
            new = old
        out.append(new.cast(types[c]).alias(c))
    return rows.select(*out)


def action_counts(plan: MergePlan, source: DataFrame, target: DataFrame) -> DataFrame:
    """(action, rows): what a merge would do."""
    return joined(plan, source, target).groupBy(F.col("__action").alias("action")).agg(F.count(F.lit(1)).alias("rows"))
