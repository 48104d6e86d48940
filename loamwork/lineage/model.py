"""Column names shared by the lineage tables, and comparisons over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamwork.functions.names import key

PARTS = ("server", "database", "schema", "object")
SOURCE = [f"source{p}" for p in PARTS]
TARGET = [f"target{p}" for p in PARTS]
ROOT = [f"root{p}" for p in PARTS]
DEPENDENT = [f"dependent{p}" for p in PARTS]
OBJECT = ["servername", "databasename", "schemaname", "objectname"]
REFERENCING = [f"referencing{p}" for p in PARTS]
REFERENCED = ["referenced_server_name", "referenced_database_name", "referenced_schema_name", "referenced_entity_name"]


def packed(columns: list[str]) -> Column:
    """One comparable text for a name of several parts; null where a part is null."""
    return F.concat_ws("\x1f", *(key(c) for c in columns)) if len(columns) == 1 else F.when(_all_there(columns), F.concat_ws("\x1f", *(key(c) for c in columns)))


def _all_there(columns: list[str]) -> Column:
    out = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        out = out & F.col(c).isNotNull()
    return out


def dotted(columns: list[str]) -> Column:
    return F.concat_ws(".", *columns)
