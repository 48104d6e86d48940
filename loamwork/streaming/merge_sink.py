"""Merges over a stream: each micro-batch is one merge into a versioned table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from loamwork.merge.config import SCD4, MergeConfig
from loamwork.merge.scd1 import scd1
from loamwork.merge.scd2 import scd2
from loamwork.plans.merge_plan import make_plan
from loamwork.sources.tables import VersionedTable


def merge_stream(stream: DataFrame, config: MergeConfig, target: VersionedTable, clock: Callable[[int], dt.datetime], keep: int = 3) -> DataStreamWriter:
    """Writer that merges each micro-batch of ``stream`` into ``target``; not for merges with a history table.

    ``clock`` gives the time of a batch by its number, so that a batch run again gives the same state.
    """
    if config.scd_type == SCD4:
        raise ValueError("a merge with a history table writes two tables and can't be one state")

    def absorb(batch: DataFrame, number: int) -> None:
        former = target.read(below=number + 1)
        plan = make_plan(config, batch, former)
        merge = scd1 if config.scd_type == "SCD1" else scd2
        target.write(merge(plan, batch, former, config.now(clock(number))), number + 1)
        target.forget(keep)

    return stream.writeStream.foreachBatch(absorb)
