"""Merges of one delivery after another into the same tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame

from loamwork.merge.config import MergeConfig
from loamwork.merge.router import execute
from loamwork.storage import drop, settle


def merge_chain(config: MergeConfig, tables: dict[str, DataFrame], deliveries: Iterable[tuple[DataFrame, dt.datetime]]) -> dict[str, DataFrame]:
    """The tables after all deliveries (source, time of the merge), each merged into what the one before left.

    Every state is written to the shared folder before the next delivery is read, so the plan
    doesn't grow with their number. No deliveries leave the tables as they are.
    """
    for source, utc in deliveries:
        result = execute(config.name, {config.name: config}, {**tables, config.source: source}.__getitem__, utc)
        new = {name: settle(df, "merged") for name, df in result.tables.items()}
        for name in new:
            drop(tables[name])
        tables = {**tables, **new}
    return tables
