"""Reports over direct and extended dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.lineage.model import DEPENDENT, OBJECT, REFERENCED, REFERENCING, ROOT, SOURCE, TARGET, dotted, packed
from loamwork.functions.names import key


def _rooted(extended: DataFrame, name: tuple[str, str, str, str]) -> DataFrame:
    same = F.lit(True)
    for c, n in zip(ROOT, name, strict=True):
        same = same & (key(c) == n.strip().lower())
    return extended.where(same)


def object_dependency(extended: DataFrame, name: tuple[str, str, str, str], direction: str = "Both") -> DataFrame:
    """Paths from one object, ordered by direction, level and dependent."""
    rows = _rooted(extended, name)
    if direction != "Both":
        rows = rows.where(F.col("lineagedirection") == direction)
    return rows.select("lineagedirection", "lineagelevel", *DEPENDENT, "dependentobjecttype", "lineagepath").orderBy("lineagedirection", "lineagelevel", *DEPENDENT)


def impact_levels(extended: DataFrame, name: tuple[str, str, str, str]) -> DataFrame:
    """Distinct objects affected at each level, and the names of all paths' ends in order."""
    down = _rooted(extended, name).where("lineagedirection = 'Downstream'").withColumn("dependent", dotted(DEPENDENT))
    listed = F.expr("listagg(dependent, ', ') within group (order by dependent)")
    return down.groupBy("lineagelevel").agg(F.countDistinct("dependent").alias("affectedobjectcount"), listed.alias("affectedobjects"))


def impact_summary(extended: DataFrame, name: tuple[str, str, str, str]) -> DataFrame:
    """One row: distinct objects affected and the greatest depth."""
    down = _rooted(extended, name).where("lineagedirection = 'Downstream'")
    return down.agg(F.countDistinct(dotted(DEPENDENT)).alias("totalaffectedobjects"), F.max("lineagelevel").alias("maxdependencydepth"))


def cross_database(edges: DataFrame) -> DataFrame:
    """Edges between servers or databases, with their scope."""
    servers, databases = key("sourceserver") != key("targetserver"), key("sourcedatabase") != key("targetdatabase")
    scope = F.when(servers, "Cross-Server").when(databases, "Cross-Database").alias("scope")
    return edges.where(servers | databases).select(*SOURCE, "sourcetype", *TARGET, "targettype", scope).orderBy("scope", "sourceserver", "sourcedatabase", "targetserver", "targetdatabase", "sourceschema", "sourceobject")


def circular(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is an edge too, edges of an object to itself among them."""
    back = edges.select(packed(TARGET).alias("s"), packed(SOURCE).alias("t")).distinct()
    return edges.withColumns({"s": packed(SOURCE), "t": packed(TARGET)}).join(back, ["s", "t"], "left_semi").select(*SOURCE, *TARGET, F.lit("Circular Reference Detected").alias("issue")).distinct()


def orphaned(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects that no edge touches; two anti-joins, one for each end."""
    ends = lambda columns: edges.select(packed(columns).alias("__name")).distinct()
    return objects.withColumn("__name", packed(OBJECT)).join(ends(SOURCE), "__name", "left_anti").join(ends(TARGET), "__name", "left_anti").drop("__name")


def object_summary(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Each object with the number of edges from it and to it."""
    count = lambda columns, name: edges.groupBy(packed(columns).alias("__name")).agg(F.count(F.lit(1)).alias(name)).where("__name is not null")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        objects.withColumn("__name", packed(OBJECT))
        .join(count(SOURCE, "__out"), "__name", "left")
        .join(count(TARGET, "__in"), "__name", "left")
        .withColumns({"dependsoncount": zero("__out"), "dependedbycount": zero("__in"), "totaldependencies": zero("__out") + zero("__in")})
        .drop("__name", "__out", "__in")
    )


def parsed_versus_expression(parsed: DataFrame, expression: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges that only one of the two sources knows: (comparisonresult, source parts, operationtype, target parts).

    ``parsed`` is as the parser gives it, the referring object first. Constraints (CK...), edges of an object to itself and edges to unknown objects are left out.
    """
    known = objects.select(packed(OBJECT).alias("__to")).distinct()

    def ready(df: DataFrame, source: list[str], target: list[str], op: Column) -> DataFrame:
        named = [F.col(a).alias(b) for a, b in zip([*source, *target], [*SOURCE, *TARGET], strict=True)]
        rows = df.select(*named, op.alias("operationtype")).withColumns({"__from": packed(SOURCE), "__to": packed(TARGET)})
        return rows.where(~key("sourceobject").startswith("ck") & (F.col("__from") != F.col("__to"))).join(known, "__to", "left_semi")

    p = ready(parsed, SOURCE, TARGET, F.col("operationtype"))
    e = ready(expression, REFERENCING, REFERENCED, F.lit(None).cast("string"))
    only = lambda a, b, name: a.join(b.select("__from", "__to").distinct(), ["__from", "__to"], "left_anti").select(F.lit(name).alias("comparisonresult"), *SOURCE, "operationtype", *TARGET).distinct()
    return only(p, e, "ParsedOnly").union(only(e, p, "ExpressionOnly"))
