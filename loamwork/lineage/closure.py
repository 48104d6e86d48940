"""Extended dependencies: every path from an object down to what it feeds, or up to what feeds it.

Level-wise joins of paths with edges; one row a path, so the levels of a dense
graph grow fast and ``max_levels`` bounds them. The ways of up to four edges are made first, and a
join with them goes four levels at once, so that only every fourth level's paths move. Distinct ways extend distinct
paths to distinct paths; only edges that differ in their objects' types alone make a level look for repeats.
Each round is written to the shared folder, so a lost executor costs one round at most. Paths and ways are shuffled by
the object where they meet, where adaptive execution splits an object that very many paths reach.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.lineage.exclusions import object_excluded
from loamwork.lineage.model import DEPENDENT, ROOT, SOURCE, TARGET, dotted, packed
from loamwork.storage import drop, settle

OUT = [*ROOT, "rootobjecttype", *DEPENDENT, "dependentobjecttype", "lineagepath", "lineagelevel", "lineagedirection"]


#: Levels that one join goes; a power of two.
SPAN = 4


def _ways(single: DataFrame, reach: int, once: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(from, to, next, nodes, text, hops) of all ways of up to ``reach`` edges that meet no object twice, made of single ones; each join doubles them."""
    ways, most = single, 1
    while most < reach:
        first = ways.where(F.col("hops") == most).select(F.col("from").alias("begin"), F.col("to").alias("mid"), F.col("nodes").alias("before"), F.col("text").alias("lead"), F.col("hops").alias("done"))
        longer = first.join(ways, F.col("mid") == F.col("from")).where(~F.arrays_overlap(F.concat(F.array("begin"), "before"), "nodes")).where(F.col("hops") <= reach - most)
        added = longer.select(F.col("begin").alias("from"), "to", "next", F.concat("before", "nodes").alias("nodes"), F.concat("lead", "text").alias("text"), (F.col("done") + F.col("hops")).alias("hops"))
        former, ways, most = ways, settle(once(ways.union(added)), "ways"), most * 2
        drop(former)
    return ways


def _direction(edges: DataFrame, exclusions: DataFrame | None, max_levels: int, downstream: bool, compat: bool) -> DataFrame:
    near, far = (SOURCE, TARGET) if downstream else (TARGET, SOURCE)
    near_type, far_type = ("sourcetype", "targettype") if downstream else ("targettype", "sourcetype")
    arrow = " -> " if downstream else " <- "
    kept = edges if exclusions is None else object_excluded(edges, far, exclusions)
    hops = settle(
        kept.where(packed(near).isNotNull() & packed(far).isNotNull())
        .select(
            packed(near).alias("near_key"),
            packed(far).alias("far_key"),
            dotted(near).alias("near_name"),
            dotted(far).alias("far_name"),
            F.struct(*(F.col(c).alias(d) for c, d in zip([*near, near_type], [*ROOT, "rootobjecttype"], strict=True))).alias("near"),
            F.struct(*(F.col(c).alias(d) for c, d in zip([*far, far_type], [*DEPENDENT, "dependentobjecttype"], strict=True))).alias("far"),
        )
        .distinct(),
        "hops",
    )
    paths = hops.select("near", "far", F.col("far_key").alias("last"), F.array("near_key", "far_key").alias("on_path"), F.concat("near_name", F.lit(arrow), "far_name").alias("lineagepath"), F.lit(1).alias("lineagelevel"))
    ends = hops.select("near_key", "far_key", "far_name", "far").distinct()
    repeats = not ends.groupBy("near_key", "far_key", "far_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    once = (lambda df: df.distinct()) if repeats else (lambda df: df)
    single = ends.select(F.col("near_key").alias("from"), F.col("far_key").alias("to"), F.col("far").alias("next"), F.array("far_key").alias("nodes"), F.concat(F.lit(arrow), "far_name").alias("text"), F.lit(1).alias("hops"))
    reach = 1 if compat else min(SPAN, max_levels)
    step = _ways(settle(single, "ways"), reach, once)
    levels, at = [settle(once(paths), "level")], 1
    while at < max_levels:
        down = min(max(reach - at % reach, 1), max_levels - at)
        grown = levels[-1].where(F.col("lineagelevel") == at).join(step.where(F.col("hops") <= down), F.col("last") == F.col("from"))
        met = F.instr(F.lower("lineagepath"), F.lower(F.substr("text", F.lit(len(arrow) + 1)))) > 0 if compat else F.arrays_overlap("on_path", "nodes")
        level = grown.where(~met).select(
            "near", F.col("next").alias("far"), F.col("to").alias("last"), F.concat("on_path", "nodes").alias("on_path"), F.concat("lineagepath", "text").alias("lineagepath"), (F.col("lineagelevel") + F.col("hops")).alias("lineagelevel")
        )
        level = settle(once(level), "level")
        if level.isEmpty():
            break
        levels.append(level)
        at += down
    drop(step)
    out = levels[0]
    for p in levels[1:]:
        out = out.union(p)
    return once(out.select("near.*", "far.*", "lineagepath", "lineagelevel", F.lit("Downstream" if downstream else "Upstream").alias("lineagedirection")).select(*OUT))


def extended_dependencies(edges: DataFrame, exclusions: DataFrame | None = None, max_levels: int = 30, directions: tuple[str, ...] = ("Downstream", "Upstream"), compat: bool = False) -> DataFrame:
    """All paths over one to ``max_levels`` edges that meet no object twice.

    Edges into excluded objects are left out. An edge from an object to itself
    is a path of one level. With ``compat`` an object also counts as met when its name is part of the path's text.
    """
    out = None
    for d in directions:
        one = _direction(edges, exclusions, max_levels, d == "Downstream", compat)
        out = one if out is None else out.union(one)
    return out


def depth_limits(extended: DataFrame, max_levels: int = 30) -> DataFrame:
    """Roots with a path of the greatest length allowed, per direction."""
    return extended.where(F.col("lineagelevel") == max_levels).select(*ROOT, "lineagedirection", F.lit(max_levels).alias("maxlevel")).distinct()
