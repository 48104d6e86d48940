"""Duplicates hidden by formatting differences, counted in an incremental ledger.

The ledger says for each canonical key how many records had it, and which is
the earliest of them. It consists of runs, hash-bucketed and sorted on the key.
A batch is first aggregated by key, which a group of copies of any size leaves
as one row a task, and becomes a run. Runs of like size are full-outer-joined
bucket by bucket, without moving them: counts add up, and the least id stays;
reading the ledger joins the few runs there are in the same way. A batch so
writes its own keys, and a key is rewritten a logarithmic number of times. The
manifest that names the runs is published when they are complete, and a ledger
with a path outlives the application.

Defined results: a null text has no key and is no duplicate; other null parts
equal each other and nothing else; ties can't occur as the least id is taken;
repeated ids count as copies; empty batches change nothing. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.storage import RunStore, settle, shuffle_partitions


def letters(c: Column | str) -> Column:
    """Letters and digits only, without case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", "")


def joined(*parts: Column) -> Column:
    """Unambiguous text of several parts; null differs from empty."""
    return F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts))


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def ordered_key(ordered: list[Column], either: list[Column]) -> Column:
    """Key of a record whose ``either`` fields may have changed places."""
    swapped = F.array_sort(F.array(*(F.coalesce(F.concat(F.lit("="), letters(c)), F.lit("-")) for c in either)))
    return digest(joined(*map(letters, ordered), F.concat_ws("|", swapped)))


def statement_key(c: Column | str) -> Column:
    """Key of a select statement: what stands before the list, the list's entries in any order, and what follows from ``from`` on.

    Every comma separates entries, those within parentheses too. A text without such a list is compared as a whole.
    """
    c = F.col(c) if isinstance(c, str) else c
    # one match of the text gives all three parts
    cut = F.regexp_replace(F.translate(c, "\x00", " "), r"(?is)^(.*?\bselect\b)(.*?)(\bfrom\b.*)$", "$1\x00$2\x00$3")

    def form(p: Column) -> Column:
        entries = F.array_sort(F.transform(F.split(p[1], ","), letters))
        return F.when(F.size(p) == 3, joined(letters(p[0]), F.concat_ws(",", entries), letters(p[2]))).otherwise(joined(letters(c)))

    return digest(F.transform(F.array(F.split(cut, "\x00")), form)[0])


class Ledger:
    """Counts and earliest record of each canonical key; as many buckets as the session has shuffle partitions, unless given.

    With ``path`` the ledger is kept there, and opened again by a later session.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, path: str | None = None, fanout: int = 2) -> None:
        self.fanout = fanout
        self.store = RunStore(spark, path, {"buckets": buckets or shuffle_partitions(spark)}, "ledger")
        self.buckets = self.store.settings["buckets"]

    def absorb(self, batch: DataFrame, batch_id: str | None = None) -> int:
        """Add a batch of (key, id); gives the bytes written. A batch of an id absorbed before adds nothing."""
        if batch_id is not None and batch_id in self.store.batches:
            return 0
        before = self.store.written
        # the aggregate has put its rows where the buckets are, if there are as many
        placed = self.buckets == shuffle_partitions(self.store.spark)
        self.store.add("keys", batch.where("key is not null").groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "key", self.buckets, placed=placed)
        self.store.compact("keys", self.fanout, _sum, placed=True)
        self.store.publish(batch_id)
        return self.store.written - before

    def df(self) -> DataFrame:
        """(key, first_id, copies)"""
        return _sum([r.df() for r in self.store.of("keys")])

    def copies(self, records: DataFrame) -> DataFrame:
        """(first_id, copy_id) of records (key, id) that aren't the first of their key.

        Keys without copies are left out. At most a thousand keys can hold more than a thousandth of
        the records each; those are broadcast, so a hot key's records stay where they are.
        """
        dup = settle(self.df().where("copies > 1").select("key", "first_id", "copies"), "copies")
        total = self.df().agg(F.sum("copies")).first()[0] or 0
        hot = dup.where(F.col("copies") * 1000 > total).select("key", F.col("first_id").alias("hot_id"))
        marked = records.join(F.broadcast(hot), "key", "left")
        of_hot = marked.where("id <> hot_id").select(F.col("hot_id").alias("first_id"), F.col("id").alias("copy_id"))
        rest = marked.where("hot_id is null").join(dup, "key").where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))
        return of_hot.union(rest)


def _sum(runs: list[DataFrame]) -> DataFrame:
    """Runs full-outer-joined bucket by bucket: counts add up, and the least id stays.

    What a full outer join gives counts as placed nowhere, so more than two runs are grouped in one shuffle instead.
    """
    out = runs[0]
    if len(runs) > 2:
        for r in runs[1:]:
            out = out.union(r.select(*out.columns))
        return out.groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    for r in runs[1:]:
        other = r.select("key", F.col("first_id").alias("f"), F.col("copies").alias("c"))
        out = out.join(other, "key", "full_outer").select("key", F.least("first_id", "f").alias("first_id"), (F.coalesce("copies", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("copies"))
    return out


def build_ledger(records: DataFrame, batches: int, buckets: int | None = None) -> Ledger:
    """Ledger of records (key, id), taken in ``batches`` batches by id."""
    ledger = Ledger(records.sparkSession, buckets)
    for i in range(batches):
        ledger.absorb(records.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == i))
    return ledger


def parsed_dependency_keys(df: DataFrame) -> DataFrame:
    """(key, id) of parsed dependencies."""
    ordered = ["sourceserver", "sourcedatabase", "sourceschema", "sourceobject", "operationtype", "targetserver", "targetdatabase"]
    return df.select(ordered_key([F.col(c) for c in ordered], [F.col("targetschema"), F.col("targetobject")]).alias("key"), F.col("parseddependencyid").alias("id"))


def definition_keys(df: DataFrame) -> DataFrame:
    """(key, id) of object definitions; a null text has a null key."""
    return df.select(F.when(F.col("objectdefinition").isNotNull(), statement_key("objectdefinition")).alias("key"), F.col("definitionid").alias("id"))
