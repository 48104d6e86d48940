"""Run a stored merge by its name."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from loamwork.merge.config import SCD1, SCD4, MergeConfig
from loamwork.merge.scd1 import action_counts, scd1
from loamwork.merge.scd2 import scd2
from loamwork.merge.scd4 import scd4
from loamwork.plans.merge_plan import MergePlan, make_plan

log = logging.getLogger(__name__)


@dataclass
class MergeResult:
    """New states of the tables by name; in a dry run the plan and what it would do instead."""

    plan: MergePlan
    tables: dict[str, DataFrame]
    text: str | None = None
    actions: DataFrame | None = None


def execute(name: str, configs: dict[str, MergeConfig], table: Callable[[str], DataFrame], utc_now: dt.datetime, debug: bool = False, identity: tuple[str, ...] = ()) -> MergeResult | None:
    """Merge as the configuration ``name`` says; ``None``, and a message, if there is none.

    ``table`` gives the table of a name. Nothing is written: the caller replaces the tables, all or none.
    """
    config = next((c for n, c in configs.items() if n.lower() == name.lower()), None)
    if config is None:
        log.warning("Merge configuration [%s] was not found.", name)
        return None
    source, target = table(config.source), table(config.target)
    plan = make_plan(config, source, target, identity)
    if debug:
        return MergeResult(plan, {}, plan.text(), action_counts(plan, source, target))
    now = config.now(utc_now)
    if config.scd_type == SCD1:
        return MergeResult(plan, {config.target: scd1(plan, source, target, now)})
    if config.scd_type == SCD4:
        current, history = scd4(plan, source, target, table(config.history), now)
        return MergeResult(plan, {config.target: current, config.history: history})
    return MergeResult(plan, {config.target: scd2(plan, source, target, now)})
