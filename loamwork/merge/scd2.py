"""Merges that keep versions of a row: by number, by date, or by date with a current flag.

Only the merge by version follows given semantics. The two by date are
inferred from the columns their configuration asks for: an open row carries
the expiration value; a change expires it now and opens another.

All three: a soft-deleted row stays the open one; if its key comes back
unchanged it stays deleted, if changed it is closed and a new row is not deleted.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.merge.config import SCD2_VERSION
from loamwork.plans.merge_plan import MergePlan, differs, require_unique, same_key, source_side


def _open(plan: MergePlan) -> Column:
    if "is_current" in plan.kept:
        return F.coalesce(F.col(plan.kept["is_current"]).cast("int"), F.lit(0)) == 1
    return F.coalesce(F.col(plan.kept["row_expiration"]) == F.lit(plan.config.row_expiration_value).cast("timestamp_ntz"), F.lit(False))


def scd2(plan: MergePlan, source: DataFrame, target: DataFrame, now: dt.datetime) -> DataFrame:
    """The target after the merge, in its own columns.

    Closed rows pass through without a join; the open ones meet the source in one full outer join.
    """
    require_unique(plan, source)
    kept, types = plan.kept, dict(target.dtypes)
    moment = F.lit(now).cast("timestamp_ntz")
    forever = F.lit(plan.config.row_expiration_value).cast("timestamp_ntz")
    is_open = _open(plan)
    both = source_side(plan, source).join(target.where(is_open).withColumn("__in_target", F.lit(1)), same_key(plan), "full_outer")
    changed = F.col("__in_source").isNotNull() & F.col("__in_target").isNotNull() & differs(plan)
    gone = F.lit(plan.config.delete_if_not_matched) & F.col("__in_source").isNull() & (F.coalesce(F.col(kept["is_deleted"]).cast("int"), F.lit(0)) == 0)
    both = both.withColumns({"__changed": changed, "__gone": gone})

    closing = {"is_current": F.lit(0), "row_expiration": moment, "modified": moment}
    old = []
    for c in plan.target_columns:
        role = next((r for r, n in kept.items() if n == c), None)
        new = F.col(f"`{c}`")
        if role in closing:
            new = F.when(F.col("__changed"), closing[role]).otherwise(new)
        if role == "is_deleted":
            new = F.when(F.col("__gone"), 1).otherwise(new)
        if role == "modified":
            new = F.when(F.col("__gone"), moment).otherwise(new)
        old.append(new.cast(types[c]).alias(c))
    stay = both.where("__in_target is not null").select(*old)

    fresh = both.where("__in_target is null or __changed").select(*(f"__s_{c}" for c in (*plan.keys, *plan.compared)))
    opening = {"create": moment, "modified": moment, "is_current": F.lit(1), "is_deleted": F.lit(0), "row_effective": moment, "row_expiration": forever}
    if plan.config.scd_type == SCD2_VERSION:
        last = target.groupBy(*(F.col(f"`{k}`") for k in plan.keys)).agg(F.max(kept["version"]).alias("__last_version"))
        fresh = fresh.join(last, same_key(plan), "left")
        opening["version"] = F.coalesce("__last_version", F.lit(0)) + 1
    new_row = []
    for c in plan.target_columns:
        role = next((r for r, n in kept.items() if n == c), None)
        value = opening[role] if role else F.col(f"__s_{c}") if c in (*plan.keys, *plan.compared) else F.lit(None)
        new_row.append(value.cast(types[c]).alias(c))
    return target.where(~is_open).union(stay).union(fresh.select(*new_row))
