"""References to records that do not exist, direct and inherited.

A reference is a direct orphan if no record of its key exists at its time.
Then a fixpoint cascade: what refers to a record that holds an orphan
reference is an inherited orphan, one step further down the foreign keys,
until a semi-join finds nothing new.

Defined results: a reference with neither key is a direct orphan; one without
time is satisfied by any record of its key; repeated records count once, and
each repeated reference is reported; records with a null key satisfy nothing;
empty tables give no rows (or, without records, every reference).
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.names import full_key
from loamwork.storage import Parts, settle


def existences(records: DataFrame, keys: list[Column], begins: Column, ends: Column) -> DataFrame:
    """Distinct (key, begins, ends) of all kinds of keys; ends is open."""
    out = None
    for k in keys:
        one = records.select(k.alias("key"), begins.alias("begins"), ends.alias("ends")).where("key is not null")
        out = one if out is None else out.union(one)
    return out.distinct()


def direct_orphans(references: DataFrame, key: Column, at: Column, records: DataFrame) -> DataFrame:
    """Rows of ``references`` whose key has no record at the time ``at``.

    ``records`` comes from ``existences``. The reference side may be skewed:
    it is the side an adaptive skew join splits, while the records of a key are few and distinct.
    """
    left = references.withColumns({"__key": key, "__at": at})
    r = records
    hit = (F.col("__key") == r.key) & (F.col("__at").isNull() | ((r.begins.isNull() | (r.begins <= F.col("__at"))) & (r.ends.isNull() | (F.col("__at") < r.ends))))
    return left.join(r, hit, "left_anti").drop("__key", "__at")


def cascade(references: DataFrame, orphaned: DataFrame, key: Column, owner_keys: list[Column], row: str) -> DataFrame:
    """The orphans among ``references`` with their ``hop``: 0 for those of ``orphaned``, n for rows that refer to the owner of a row of hop n - 1.

    Works on distinct (referred key, owner keys), so a hot owner costs one row a round. ``row`` numbers the rows.
    """
    owners = F.array(*owner_keys)
    edges = settle(references.select(key.alias("key"), owners.alias("owners")).where("key is not null").distinct(), "fk")
    frontier = settle(orphaned.select(F.explode(owners).alias("key")).where("key is not null").distinct().withColumn("hop", F.lit(0)), "tainted")
    tainted = Parts(frontier, "tainted")
    for hop in itertools.count(1):  # ends at the first empty round: each round taints keys not met before
        hit = edges.join(frontier.select("key"), "key", "left_semi").select(F.explode("owners").alias("key")).where("key is not null").distinct()
        fresh = settle(hit.join(tainted.df().select("key"), "key", "left_anti").withColumn("hop", F.lit(hop)), "tainted")
        if fresh.isEmpty():
            break
        tainted.add(fresh)
        frontier = fresh
    levels = tainted.df()
    levels = levels.groupBy(F.col("key").alias("__key")).agg(F.min("hop").alias("__hop"))
    direct = orphaned.withColumn("hop", F.lit(0))
    rest = references.withColumn("__key", key).join(levels, "__key").join(orphaned.select(row), row, "left_anti")
    return direct.unionByName(rest.select(*references.columns, (F.col("__hop") + 1).alias("hop")))


def object_orphans(expression_dependency: DataFrame, object_list: DataFrame) -> DataFrame:
    """Orphans among references between database objects.

    (expressiondependencyid, referencedobjecttype, capturedate, orphan_kind, hop). An id
    decides alone where given, else the normalised name does.
    """
    objects = object_list.select("objectid", full_key("servername", "databasename", "schemaname", "objectname").alias("name"), "createdate", "dropdate")
    records = existences(objects, [F.concat(F.lit("i"), F.col("objectid").cast("string")), F.concat(F.lit("n"), F.col("name"))], F.col("createdate"), F.col("dropdate"))
    rows = expression_dependency.select(
        "expressiondependencyid",
        "referencedobjecttype",
        "capturedate",
        F.coalesce(
            F.concat(F.lit("i"), F.col("referenced_id").cast("string")),
            F.concat(F.lit("n"), full_key("referenced_server_name", "referenced_database_name", "referenced_schema_name", "referenced_entity_name")),
        ).alias("ref_key"),
        F.concat(F.lit("i"), F.col("referencingobjectid").cast("string")).alias("owner_id"),
        F.concat(F.lit("n"), full_key("referencingserver", "referencingdatabase", "referencingschema", "referencingobject")).alias("owner_name"),
    )
    # rows may be equal or lack an id, so they are numbered, and written so that the numbers stay
    refs = settle(rows.withColumn("row", F.monotonically_increasing_id()), "references")
    direct = settle(direct_orphans(refs, F.col("ref_key"), F.col("capturedate"), records), "orphans")
    found = cascade(refs, direct, F.col("ref_key"), [F.col("owner_id"), F.col("owner_name")], "row")
    kind = F.when(F.col("hop") == 0, "direct").otherwise("inherited").alias("orphan_kind")
    return found.select("expressiondependencyid", "referencedobjecttype", "capturedate", kind, "hop")
