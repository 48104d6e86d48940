"""The whole way from an inventory to extended dependencies."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from loamwork.lineage import exclusions as x
from loamwork.lineage.catalog import expression_dependencies, object_definitions, object_list
from loamwork.lineage.closure import depth_limits, extended_dependencies
from loamwork.lineage.edges import cleanse, direct_dependencies
from loamwork.lineage.normalize import remove_comments
from loamwork.lineage.parser import parsed_dependencies
from loamwork.storage import settle


@dataclass
class Lineage:
    """Tables of one full load."""

    objects: DataFrame
    definitions: DataFrame
    expression: DataFrame | None
    parsed: DataFrame
    cleansed: DataFrame
    direct: DataFrame
    extended: DataFrame
    limits: DataFrame


def full_load(
    inventory: DataFrame,
    texts: DataFrame,
    server: str,
    now: dt.datetime,
    database_exclusions: DataFrame,
    object_exclusions: DataFrame | None = None,
    catalog_edges: DataFrame | None = None,
    dynamic_merge: DataFrame | None = None,
    max_levels: int = 30,
    compat: bool = False,
) -> Lineage:
    """All steps in order; the edges are written once, before the closure reads them again and again."""
    excluded = x.add_defaults(database_exclusions, now, "full load")
    objects = object_list(inventory, excluded)
    definitions = remove_comments(object_definitions(objects, texts))
    expression = None if catalog_edges is None else expression_dependencies(catalog_edges, excluded)
    parsed = settle(parsed_dependencies(definitions, compat), "parsed")
    cleansed = cleanse(parsed, objects, server)
    direct = settle(direct_dependencies(cleansed, objects, dynamic_merge, compat), "direct")
    extended = settle(extended_dependencies(direct, object_exclusions, max_levels, compat=compat), "extended")
    return Lineage(objects, definitions, expression, parsed, cleansed, direct, extended, depth_limits(extended, max_levels))
