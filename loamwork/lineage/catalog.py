"""Inventory of objects, their definitions, and the dependencies a catalog reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.lineage.exclusions import database_excluded
from loamwork.functions.names import key

#: Object types that are listed, and the type names that have a definition.
LISTED = ("U", "V", "P", "SN", "SO", "FN", "IF", "TF")
DEFINED = ("CHECK_CONSTRAINT", "DEFAULT_CONSTRAINT", "SQL_SCALAR_FUNCTION", "SQL_STORED_PROCEDURE", "SQL_TABLE_VALUED_FUNCTION", "SQL_INLINE_TABLE_VALUED_FUNCTION", "SQL_TRIGGER", "VIEW")


def object_list(inventory: DataFrame, database_exclusions: DataFrame) -> DataFrame:
    """Objects of listed types in databases that aren't excluded, with ``fullobjectname``.

    ``inventory`` has servername, databasename, schemaname, objectname, objecttype and any other columns;
    rows with is_ms_shipped = 1 are left out where that column is there.
    """
    own = inventory.where(key("objecttype").isin(*(t.lower() for t in LISTED)))
    if "is_ms_shipped" in inventory.columns:
        own = own.where(F.coalesce(F.col("is_ms_shipped").cast("int"), F.lit(0)) == 0)
    kept = database_excluded(own, "servername", "databasename", database_exclusions)
    return kept.withColumn("fullobjectname", F.concat_ws(".", *(F.coalesce(c, F.lit("")) for c in ("databasename", "schemaname", "objectname"))))


def object_definitions(objects: DataFrame, texts: DataFrame) -> DataFrame:
    """Objects of types that have a definition, with the text from ``texts`` (objectid, objectdefinition)."""
    able = objects.where(key("objecttypename").isin(*(t.lower() for t in DEFINED)))
    cols = ["objectid", "servername", "databasename", "schemaname", "objectname", "objecttype"]
    return able.select(*cols).distinct().join(texts.select("objectid", "objectdefinition"), "objectid")


def expression_dependencies(catalog_edges: DataFrame, database_exclusions: DataFrame) -> DataFrame:
    """Edges a catalog reports, completed: the missing server and database are the referrer's own, the missing schema the resolved one or dbo.

    Column-level edges (referencing_minor_id other than 0) are left out.
    """
    edges = catalog_edges.where(F.coalesce("referencing_minor_id", F.lit(0)) == 0) if "referencing_minor_id" in catalog_edges.columns else catalog_edges
    resolved = F.col("resolved_schema_name") if "resolved_schema_name" in catalog_edges.columns else F.lit(None).cast("string")
    whole = edges.withColumns(
        {
            "referenced_server_name": F.coalesce("referenced_server_name", "referencingserver"),
            "referenced_database_name": F.coalesce("referenced_database_name", "referencingdatabase"),
            "referenced_schema_name": F.coalesce(F.col("referenced_schema_name"), resolved, F.lit("dbo")),
        }
    )
    return database_excluded(whole, "referenced_server_name", "referenced_database_name", database_exclusions)


INVENTORY = "servername string, databasename string, schemaname string, objectname string, objecttype string, objecttypename string, objectid long"


def spark_inventory(spark: SparkSession, server: str, databases: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Inventory of the tables, views and functions of Spark databases, and the message of each database that can't be read.

    A failing database is skipped, the others are listed. Names come from the catalog's lists, which the driver holds.
    """
    rows: list[tuple] = []
    failed: dict[str, str] = {}
    for d in databases:
        try:
            views = {t.name for t in spark.catalog.listTables(d) if t.tableType == "VIEW" and not t.isTemporary}
            tables = {t.name for t in spark.catalog.listTables(d) if not t.isTemporary} - views
            functions = {r[0].rsplit(".", 1)[-1] for r in spark.sql(f"SHOW USER FUNCTIONS IN {quoted_identifier(d)}").collect()}
        except Exception as e:  # noqa: BLE001 - whatever a catalog raises concerns this database alone
            failed[d] = str(e).splitlines()[0]
            continue
        for names, kind, kind_name in ((tables, "U", "USER_TABLE"), (views, "V", "VIEW"), (functions, "FN", "SQL_SCALAR_FUNCTION")):
            rows += [(server, d, "default", n, kind, kind_name) for n in sorted(names)]
    names = spark.createDataFrame(rows, INVENTORY.rsplit(",", 1)[0])
    return names.withColumn("objectid", F.xxhash64("databasename", "objectname", "objecttype")), failed


def quoted_identifier(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def spark_view_texts(spark: SparkSession, inventory: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(objectid, objectdefinition) of the views among an inventory of Spark objects, and the message of each that can't be shown."""
    rows: list[tuple] = []
    failed: dict[str, str] = {}
    for r in inventory.where("objecttype = 'V'").select("objectid", "databasename", "objectname").collect():
        name = f"{quoted_identifier(r[1])}.{quoted_identifier(r[2])}"
        try:
            rows.append((r[0], spark.sql(f"SHOW CREATE TABLE {name}").first()[0]))
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e).splitlines()[0]
    return spark.createDataFrame(rows, "objectid long, objectdefinition string"), failed
