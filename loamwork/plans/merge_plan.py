"""What a merge does to which columns, worked out from a configuration and two schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.merge.config import MergeConfig


@dataclass(frozen=True)
class MergePlan:
    """Columns in the target's spelling; ``source_name`` gives the source's."""

    config: MergeConfig
    keys: tuple[str, ...]
    compared: tuple[str, ...]
    target_columns: tuple[str, ...]
    source_name: dict[str, str]
    kept: dict[str, str]

    def text(self) -> str:
        """The plan in words, for a dry run."""
        c = self.config
        lines = [
            f"{c.scd_type} merge [{c.name}]: {c.source} into {c.target}",
            f"on {', '.join(self.keys)}",
            f"compare and set {', '.join(self.compared) or 'nothing'}",
            f"fill {', '.join(f'{role} {name}' for role, name in self.kept.items())}",
            "rows missing from the source: " + ("deleted" if c.delete_if_not_matched else "left alone"),
        ]
        return "\n".join(lines)


def make_plan(config: MergeConfig, source: DataFrame, target: DataFrame, identity: tuple[str, ...] = ()) -> MergePlan:
    """Compared columns are those that both sides have, but for keys, ignored, filled and (if so configured) identity columns."""
    there = {c.lower(): c for c in source.columns}
    spelled = {c.lower(): c for c in target.columns}
    keys = [k.lower() for k in config.keys()]
    kept = {role: spelled[c.lower()] for role, c in config.kept().items() if c and c.lower() in spelled}
    left_out = {*keys, *(c.lower() for c in config.ignored()), *(c.lower() for c in kept.values())}
    if config.ignore_identity:
        left_out |= {c.lower() for c in identity}
    compared = tuple(c for low, c in spelled.items() if low in there and low not in left_out)
    return MergePlan(config, tuple(spelled[k] for k in keys), compared, tuple(target.columns), {c: there[c.lower()] for c in (*(spelled[k] for k in keys), *compared)}, kept)


def source_side(plan: MergePlan, source: DataFrame) -> DataFrame:
    """The source's keys and compared columns, as __s_<target's spelling>."""
    return source.select(*(F.col(f"`{plan.source_name[c]}`").alias(f"__s_{c}") for c in (*plan.keys, *plan.compared)), F.lit(1).alias("__in_source"))


def same_key(plan: MergePlan) -> Column:
    """Keys match by plain equality: null matches nothing."""
    out = None
    for k in plan.keys:
        one = F.col(f"__s_{k}") == F.col(f"`{k}`")
        out = one if out is None else out & one
    return out


def differs(plan: MergePlan) -> Column:
    """Any compared column differs; null is a value."""
    out = F.lit(False)
    for c in plan.compared:
        out = out | ~F.col(f"__s_{c}").eqNullSafe(F.col(f"`{c}`"))
    return out


def require_unique(plan: MergePlan, source: DataFrame) -> None:
    """Raise if a key stands twice in the source; keys with a null never match and may repeat."""
    names = [f"`{plan.source_name[k]}`" for k in plan.keys]
    whole = " and ".join(f"{n} is not null" for n in names)
    twice = source.where(whole).groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    if not twice.isEmpty():
        raise ValueError(f"the source of [{plan.config.name}] has rows with equal keys, such as {twice.drop('__n').first()}")
