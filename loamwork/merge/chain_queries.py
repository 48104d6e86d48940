"""Queries over merges of all deliveries in turn and over faulty configurations, and their SQL.

Each feed's n-th snapshot is merged on day n; a feed without one counts as empty that day.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.merge.chain import merge_chain
from loamwork.merge.config import SCD1, SCD2_DATE_CURRENT, SCD2_VERSION, SCD4, USED, MergeConfig, MergeDefaults, ValidationError, configuration_checks, defaults_table, validate
from loamwork.merge.queries import DATA, HISTORY, KEYS, SOURCE, TARGET
from loamwork.sources.tables import table
from loamwork.storage import settle

DAY_ONE = dt.datetime(2024, 1, 1)
KEPT_TYPES = {"create": "timestamp_ntz", "modified": "timestamp_ntz", "row_effective": "timestamp_ntz", "row_expiration": "timestamp_ntz", "version": "int", "is_current": "int", "is_deleted": "int"}


def deliveries(df: DataFrame) -> DataFrame:
    """Keys, data and ``day``: the number of the feed's snapshot; of each customer the row delivered last."""
    w = Window.partitionBy(*KEYS, "snapshotno").orderBy(F.desc("deliveredat"), F.desc("sourcerowid"))
    days = df.select("feedcode", "snapshotno").distinct().withColumn("day", F.row_number().over(Window.partitionBy("feedcode").orderBy("snapshotno")))
    return df.withColumn("k", F.row_number().over(w)).where("k = 1").join(days, ["feedcode", "snapshotno"]).select(*KEYS, *DATA, "day")


def _chained(scd_type: str, which: str, name: str):  # noqa: ANN202
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = settle(deliveries(table(spark, d, "mrg_scd1_source")), "deliveries")
        defaults = MergeDefaults()
        empty = rows.drop("day").where(F.lit(False)).withColumns({getattr(defaults, r): F.lit(None).cast(KEPT_TYPES[r]) for r in USED[scd_type]})
        tables = {SOURCE: rows.drop("day"), TARGET: settle(empty, "merged"), **({HISTORY: settle(empty, "merged")} if scd_type == SCD4 else {})}
        config = MergeConfig("chain", SOURCE, TARGET, scd_type, ",".join(KEYS), history=HISTORY if scd_type == SCD4 else None, delete_if_not_matched=True)
        checked = validate(config, defaults, lambda n: tables[n].columns if n in tables else None)
        last = rows.agg(F.max("day")).first()[0] or 0
        return merge_chain(checked, tables, ((rows.where(F.col("day") == n).drop("day"), DAY_ONE + dt.timedelta(days=n - 1)) for n in range(1, last + 1)))[which]

    query.__name__ = name
    return query


#: Stored rows that break a rule each, beside those of the table: (id, name, source, target, history, kind, merge on).
FAULTY = [
    (-1, "fault kind", "d.s.a", "d.s.b", None, "SCD3", "k"), (-2, "fault source", "s.a", "d.s.b", None, "SCD1", "k"), (-3, "fault target", "d.s.a", None, None, "SCD1", "k"),
    (-4, "fault history", "d.s.a", "d.s.b", "his", "SCD4", "k"), (-5, "fault twice", "d.s.a", "d.s.b", None, "SCD1", "k"), (-6, "FAULT TWICE", "d.s.a", "d.s.b", None, "SCD1", "k"),
    (-7, "fault keys", "d.s.a", "d.s.b", None, "SCD1", "  "), (-8, None, "d", "s", "a", None, None), (-9, "fine", "d.s.a", "d.s.b", None, "SCD2Version", "k"),
]
_STORED = ["dynamicmergeconfigurationid", "mergeconfigurationname", "qualifiedsourcename", "qualifiedtargetname", "qualifiedtargethistoryname", "scdtype", "mergeoncolumns"]


def merge_configuration_faults(spark: SparkSession, d: str) -> DataFrame:
    planted = spark.createDataFrame(FAULTY, "dynamicmergeconfigurationid int, mergeconfigurationname string, qualifiedsourcename string, qualifiedtargetname string, qualifiedtargethistoryname string, scdtype string, mergeoncolumns string")
    return configuration_checks(table(spark, d, "mrg_dynamicmergeconfiguration").select(*_STORED).union(planted))


_D = MergeDefaults()
#: Tables of the sample configurations, by their columns.
COLUMNS = {"db.stage.source": [*KEYS, *DATA], "db.core.target": ["FeedCode", "CustomerID", *DATA, _D.create, _D.modified]}
_GOOD = MergeConfig("good", "db.stage.source", "db.core.target", SCD1, "feedcode, customerid")
CONFIGS = [
    _GOOD,
    replace(_GOOD, name="kind", scd_type="SCD9"),
    replace(_GOOD, name="expiration", row_expiration_value="9999-12-31"),
    replace(_GOOD, name="no source", source="db.stage.none"),
    replace(_GOOD, name="two parts", target="core.target"),
    replace(_GOOD, name="no history", scd_type=SCD4, history="db.core.history"),
    replace(_GOOD, name="no keys", merge_on=" , "),
    replace(_GOOD, name="keys", merge_on="feedcode, nothing"),
    replace(_GOOD, name="ignored", ignore="age, nothing"),
    replace(_GOOD, name="kept", scd_type=SCD2_VERSION),
    replace(_GOOD, name="renamed", create="made_on"),
]


def merge_validation(spark: SparkSession, d: str) -> DataFrame:
    """What the validation of each sample configuration says; a valid one has its ignored columns as they are stored."""
    rows = []
    for c in CONFIGS:
        try:
            rows.append((c.name, 0, validate(c, _D, COLUMNS.get).ignore))
        except ValidationError as e:
            rows += [(c.name, n, text) for n, text in enumerate(e.failures, 1)]
    return spark.createDataFrame(rows, "config string, failure int, message string")


def merge_defaults(spark: SparkSession, d: str) -> DataFrame:
    return defaults_table(spark, MergeDefaults())


QUERIES = {
    f.__name__: f
    for f in (
        _chained(SCD1, TARGET, "scd1_chain"), _chained(SCD2_VERSION, TARGET, "scd2_version_chain"), _chained(SCD2_DATE_CURRENT, TARGET, "scd2_date_current_chain"),
        _chained(SCD4, TARGET, "scd4_chain_current"), _chained(SCD4, HISTORY, "scd4_chain_history"), merge_configuration_faults, merge_validation, merge_defaults,
    )
}

_VALUES = ", ".join(DATA)
_AT = lambda i: f"(TIMESTAMP '{DAY_ONE}' + to_days(CAST({i} - 1 AS INTEGER)))"
_CHAIN = f"""WITH r AS (SELECT feedcode, customerid, {_VALUES}, dense_rank() OVER (PARTITION BY feedcode ORDER BY snapshotno) AS i FROM mrg_scd1_source
  QUALIFY row_number() OVER (PARTITION BY feedcode, snapshotno, customerid ORDER BY deliveredat DESC NULLS LAST, sourcerowid DESC) = 1),
p AS (SELECT *, lag(i) OVER k AS former, lead(i) OVER k AS later, row({_VALUES}) IS DISTINCT FROM lag(row({_VALUES})) OVER k AS differs, (SELECT max(i) FROM r) AS days FROM r WINDOW k AS (PARTITION BY feedcode, customerid ORDER BY i)),
q AS (SELECT *, lead(differs) OVER k AS differs_later, sum(CASE WHEN former IS NULL OR former < i - 1 THEN 1 ELSE 0 END) OVER k AS stay, sum(CASE WHEN former IS NULL OR differs THEN 1 ELSE 0 END) OVER k AS version
  FROM p WINDOW k AS (PARTITION BY feedcode, customerid ORDER BY i)),
s AS (SELECT *, min(i) OVER g AS came, max(CASE WHEN former IS NULL OR former < i - 1 OR differs THEN i END) OVER (PARTITION BY feedcode, customerid, stay) AS touched FROM q WINDOW g AS (PARTITION BY feedcode, customerid, stay)),
v AS (SELECT feedcode, customerid, version, min(i) AS began, min(i + 1) FILTER (WHERE coalesce(later, days + 1) > i + 1) AS gone, {', '.join(f'arg_min(struct_pack(x := {c}), i).x AS {c}' for c in DATA)} FROM q GROUP BY 1, 2, 3),
w AS (SELECT *, lead(began) OVER (PARTITION BY feedcode, customerid ORDER BY version) AS ended FROM v)
"""
_ROW = f"feedcode, customerid, {_VALUES}"
_WRITTEN = [
    ("good", 0, "wh_createdatetime_utc,wh_modifieddatetime_utc"),
    ("kind", 1, "SCDType [SCD9] is not one of SCD1, SCD2Version, SCD2Date, SCD2DateAndCurrent, SCD4."),
    ("expiration", 1, "An expiration value is only for SCD2Date and SCD2DateAndCurrent."),
    ("no source", 1, "Source does not exist: db.stage.none"),
    ("no source", 2, "MergeOn column [feedcode] does not exist on source."),
    ("no source", 3, "MergeOn column [customerid] does not exist on source."),
    ("two parts", 1, "Target [core.target] needs database, schema and table."),
    ("two parts", 2, "Target does not exist: core.target"),
    ("two parts", 3, "MergeOn column [feedcode] does not exist on target."),
    ("two parts", 4, "MergeOn column [customerid] does not exist on target."),
    ("two parts", 5, "create column [WH_CreateDateTime_UTC] does not exist on target: core.target"),
    ("two parts", 6, "modified column [WH_ModifiedDateTime_UTC] does not exist on target: core.target"),
    ("no history", 1, "History does not exist: db.core.history"),
    ("no keys", 1, "MergeOnColumns is empty."),
    ("keys", 1, "MergeOn column [nothing] does not exist on source."),
    ("keys", 2, "MergeOn column [nothing] does not exist on target."),
    ("ignored", 1, "Ignore column [nothing] does not exist on source."),
    ("kept", 1, "version column [WH_Version] does not exist on target: db.core.target"),
    ("kept", 2, "is_current column [WH_isCurrent] does not exist on target: db.core.target"),
    ("kept", 3, "is_deleted column [WH_isDeleted] does not exist on target: db.core.target"),
    ("renamed", 1, "create column [made_on] does not exist on target: db.core.target"),
]
_SQL_TEXT = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_PLANTED = ", ".join(f"({', '.join(map(_SQL_TEXT, r))})" for r in FAULTY)

SQL = {
    "scd1_chain": f"{_CHAIN} SELECT {_ROW}, {_AT('came')} AS WH_CreateDateTime_UTC, {_AT('touched')} AS WH_ModifiedDateTime_UTC FROM s WHERE i = days",
    "scd2_version_chain": f"{_CHAIN} SELECT {_ROW}, {_AT('began')} AS WH_CreateDateTime_UTC, CAST(version AS INTEGER) AS WH_Version, CAST(ended IS NULL AS INTEGER) AS WH_isCurrent, CAST(gone IS NOT NULL AS INTEGER) AS WH_isDeleted FROM w",
    "scd2_date_current_chain": f"""{_CHAIN} SELECT {_ROW}, {_AT('began')} AS WH_CreateDateTime_UTC, {_AT('coalesce(ended, gone, began)')} AS WH_ModifiedDateTime_UTC, CAST(ended IS NULL AS INTEGER) AS WH_isCurrent, CAST(gone IS NOT NULL AS INTEGER) AS WH_isDeleted,
 {_AT('began')} AS WH_RowEffectiveDateTime_UTC, coalesce({_AT('ended')}, TIMESTAMP '9999-12-31') AS WH_RowExpirationDateTime_UTC FROM w""",
    "scd4_chain_current": f"{_CHAIN} SELECT {_ROW}, {_AT('came')} AS WH_CreateDateTime_UTC FROM s WHERE i = days",
    "scd4_chain_history": f"{_CHAIN} SELECT {_ROW}, {_AT('came')} AS WH_CreateDateTime_UTC FROM s WHERE i < days AND (later IS NULL OR later > i + 1 OR differs_later)",
    "merge_configuration_faults": f"""WITH c AS (SELECT {', '.join(_STORED)} FROM mrg_dynamicmergeconfiguration UNION ALL VALUES {_PLANTED}),
n AS (SELECT lower(mergeconfigurationname) AS n, count(*) AS same FROM c GROUP BY 1)
SELECT dynamicmergeconfigurationid, 'scdtype' AS problem FROM c WHERE scdtype IS NULL OR scdtype NOT IN ('SCD1', 'SCD2Version', 'SCD2Date', 'SCD2DateAndCurrent', 'SCD4')
UNION ALL SELECT dynamicmergeconfigurationid, 'qualifiedsourcename' FROM c WHERE qualifiedsourcename IS NULL OR qualifiedsourcename NOT LIKE '%.%.%'
UNION ALL SELECT dynamicmergeconfigurationid, 'qualifiedtargetname' FROM c WHERE qualifiedtargetname IS NULL OR qualifiedtargetname NOT LIKE '%.%.%'
UNION ALL SELECT dynamicmergeconfigurationid, 'qualifiedtargethistoryname' FROM c WHERE qualifiedtargethistoryname NOT LIKE '%.%.%'
UNION ALL SELECT dynamicmergeconfigurationid, 'mergeconfigurationname' FROM c WHERE mergeconfigurationname IS NULL OR lower(mergeconfigurationname) IN (SELECT n FROM n WHERE same > 1)
UNION ALL SELECT dynamicmergeconfigurationid, 'mergeoncolumns' FROM c WHERE trim(coalesce(mergeoncolumns, ''), ' ') = ''""",
    "merge_validation": f"SELECT config, CAST(failure AS INTEGER) AS failure, message FROM (VALUES {', '.join(f'({a!r}, {n}, {m!r})' for a, n, m in _WRITTEN)}) v(config, failure, message)",
    "merge_defaults": "SELECT 'WH_CreateDateTime_UTC' AS \"create\", 'WH_ModifiedDateTime_UTC' AS modified, 'WH_RowEffectiveDateTime_UTC' AS row_effective, 'WH_RowExpirationDateTime_UTC' AS row_expiration, '9999-12-31' AS row_expiration_value,"
    " 'WH_Version' AS version, 'WH_isCurrent' AS is_current, 'WH_isDeleted' AS is_deleted, 0::INTEGER AS utc_offset",
}
