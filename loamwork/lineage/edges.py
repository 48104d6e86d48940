"""Parsed references to direct dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.lineage.model import OBJECT, SOURCE, TARGET, packed
from loamwork.functions.names import key

#: Operations whose target feeds the source.
READING = ("SELECT", "EXECUTE")


def cleanse(parsed: DataFrame, objects: DataFrame, local_server: str) -> DataFrame:
    """References to known objects, once each, turned so that the source feeds the target.

    Names on other servers can't be looked up and stay. Names compare without
    regard to case and outer spaces; of equal rows the least spelling stays.
    """
    known = objects.select(packed(OBJECT).alias("__name")).distinct()
    target = packed(TARGET)
    local = parsed.where(key("targetserver") == local_server.lower()).withColumn("__name", target).join(known, "__name", "left_semi").drop("__name")
    remote = parsed.where(key("targetserver") != local_server.lower())
    both = local.unionByName(remote)
    spelled = F.struct(*SOURCE, "operationtype", *TARGET)
    one = both.groupBy(packed(SOURCE).alias("s"), key("operationtype").alias("o"), packed(TARGET).alias("t")).agg(F.min(spelled).alias("x")).select("x.*")
    turned = key("operationtype").isin(*(r.lower() for r in READING))
    swap = lambda mine, other: [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(mine, other, strict=True)]
    return one.select(*swap(SOURCE, TARGET), "operationtype", *swap(TARGET, SOURCE))


def _typed(edges: DataFrame, objects: DataFrame) -> DataFrame:
    kinds = objects.groupBy(packed(OBJECT).alias("__name")).agg(F.min(F.trim("objecttype")).alias("__type"))
    out = edges
    for side, columns in (("source", SOURCE), ("target", TARGET)):
        k = kinds.withColumnsRenamed({"__name": f"__{side}", "__type": f"__{side}type"})
        out = out.withColumn(f"__{side}", packed(columns)).join(k, f"__{side}", "left").withColumn(f"{side}type", F.coalesce(f"__{side}type", F.lit("UNKNOWN"))).drop(f"__{side}", f"__{side}type")
    return out


def direct_dependencies(edges: DataFrame, objects: DataFrame, dynamic_merge: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Distinct typed edges (source parts, sourcetype, target parts, targettype).

    ``dynamic_merge`` (source*, process*, target* names and types) adds source to process
    and process to target; with ``compat`` only the former, under the target's server name.
    """
    columns = [*SOURCE, "sourcetype", *TARGET, "targettype"]
    out = _typed(edges, objects).select(*columns).distinct()
    if dynamic_merge is None:
        return out

    def side(kind: str, as_: str, server: str | None = None) -> list[Column]:
        names = [f"{server or kind}servername", f"{kind}databasename", f"{kind}schemaname", f"{kind}objectname"]
        parts = [F.col(n).alias(f"{as_}{p}") for n, p in zip(names, ("server", "database", "schema", "object"), strict=True)]
        return [*parts, F.coalesce(f"{kind}objecttype", F.lit("UNKNOWN")).alias(f"{as_}type")]

    added = dynamic_merge.select(*side("source", "source"), *side("process", "target", "target" if compat else None))
    if not compat:
        added = added.union(dynamic_merge.select(*side("process", "source"), *side("target", "target")))
    whole = " and ".join(f"{c} is not null" for c in (*SOURCE, *TARGET))
    return out.union(added.where(whole).select(*columns)).distinct()
