"""Queries over merges, and their SQL.

The target is each feed's first snapshot, the source its last one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.merge.config import SCD1, SCD2_DATE, SCD2_DATE_CURRENT, SCD2_VERSION, SCD4, USED, MergeConfig, MergeDefaults, configuration_checks, validate
from loamwork.merge.router import execute
from loamwork.sources.tables import table

DATA = ["dateofbirth", "firstname", "lastname", "email", "country", "age", "loyaltypoints"]
KEYS = ["feedcode", "customerid"]
BEFORE, NOW = dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)
SOURCE, TARGET, HISTORY = "db.stage.source", "db.core.target", "db.core.history"


def snapshot(df: DataFrame, last: bool) -> DataFrame:
    """The rows of each feed's first or last snapshot, the last delivered one of each customer."""
    ends = df.groupBy("feedcode").agg((F.max if last else F.min)("snapshotno").alias("snapshotno"))
    w = Window.partitionBy(*KEYS).orderBy(F.desc("deliveredat"), F.desc("sourcerowid"))
    return df.join(ends, ["feedcode", "snapshotno"]).withColumn("k", F.row_number().over(w)).where("k = 1").select(*KEYS, *DATA)


def _extra(scd_type: str) -> dict:
    before, open_ = F.lit(BEFORE).cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")
    d = MergeDefaults()
    values = {"create": before, "modified": before, "row_effective": before, "row_expiration": open_, "version": F.lit(1), "is_current": F.lit(1), "is_deleted": F.lit(0)}
    return {getattr(d, r): values[r] for r in USED[scd_type]}


def merged(spark: SparkSession, d: str, scd_type: str, delete: bool) -> dict[str, DataFrame]:
    rows = table(spark, d, "mrg_scd1_source")
    tables = {SOURCE: snapshot(rows, True), TARGET: snapshot(rows, False).withColumns(_extra(scd_type))}
    if scd_type == SCD4:
        tables[HISTORY] = tables[TARGET].where(F.lit(False))
    config = MergeConfig("sample", SOURCE, TARGET, scd_type, ",".join(KEYS), history=HISTORY if scd_type == SCD4 else None, delete_if_not_matched=delete)
    checked = validate(config, MergeDefaults(), lambda n: tables[n].columns if n in tables else None)
    return execute("sample", {"sample": checked}, tables.__getitem__, NOW).tables


def _query(name: str, scd_type: str, delete: bool, which: str = TARGET):  # noqa: ANN202
    def query(spark: SparkSession, d: str) -> DataFrame:
        return merged(spark, d, scd_type, delete)[which]

    query.__name__ = name
    return query


def merge_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mrg_scd1_source")
    tables = {SOURCE: snapshot(rows, True), TARGET: snapshot(rows, False).withColumns(_extra(SCD1))}
    config = validate(MergeConfig("sample", SOURCE, TARGET, SCD1, ",".join(KEYS), delete_if_not_matched=True), MergeDefaults(), lambda n: tables[n].columns)
    return execute("sample", {"sample": config}, tables.__getitem__, NOW, debug=True).actions


def merge_configuration_checks(spark: SparkSession, d: str) -> DataFrame:
    return configuration_checks(table(spark, d, "mrg_dynamicmergeconfiguration"))


QUERIES = {
    f.__name__: f
    for f in (
        _query("scd1_merge", SCD1, False), _query("scd1_merge_delete", SCD1, True), _query("scd2_version_merge", SCD2_VERSION, False), _query("scd2_version_softdelete", SCD2_VERSION, True),
        _query("scd2_date_merge", SCD2_DATE, True), _query("scd2_date_current_merge", SCD2_DATE_CURRENT, True), _query("scd4_current", SCD4, True), _query("scd4_history", SCD4, True, HISTORY),
        merge_actions, merge_configuration_checks,
    )
}

_B, _N, _E = f"TIMESTAMP '{BEFORE}'", f"TIMESTAMP '{NOW}'", "TIMESTAMP '9999-12-31'"
_D, _K = ", ".join(DATA), ", ".join(KEYS)
_SIDE = lambda f: f"(SELECT {_K}, {_D} FROM mrg_scd1_source s JOIN (SELECT feedcode, {f}(snapshotno) AS snapshotno FROM mrg_scd1_source GROUP BY 1) USING (feedcode, snapshotno) QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY deliveredat DESC NULLS LAST, sourcerowid DESC) = 1)"
_BASE = f"WITH s AS {_SIDE('max')}, t AS {_SIDE('min')}, m AS (SELECT t.{', t.'.join(KEYS)}, s.customerid IS NOT NULL AS matched, coalesce(row({', '.join(f's.{c}' for c in DATA)}) IS DISTINCT FROM row({', '.join(f't.{c}' for c in DATA)}), true) AND s.customerid IS NOT NULL AS changed FROM t LEFT JOIN s USING ({_K}))"
_ANTI = f"FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.feedcode = s.feedcode AND t.customerid = s.customerid)"
_S = ", ".join(f"s.{c}" for c in (*KEYS, *DATA))
_T = ", ".join(f"t.{c}" for c in (*KEYS, *DATA))
_TM, _SM = f"FROM t JOIN m USING ({_K})", f"FROM s JOIN m USING ({_K}) WHERE changed"
_C, _M = "WH_CreateDateTime_UTC", "WH_ModifiedDateTime_UTC"


def _scd1_sql(delete: bool, modified: bool = True) -> str:
    mod = lambda v: f", {v} AS {_M}" if modified else ""
    return f"""{_BASE}
SELECT {_T}, {_B} AS {_C}{mod(_B)} {_TM} WHERE NOT changed{' AND matched' if delete else ''}
UNION ALL SELECT {_S}, {_B}{mod(_N)} {_SM}
UNION ALL SELECT {_S}, {_N}{mod(_N)} {_ANTI}"""


def _scd2_sql(delete: bool, old: str, new: str, fresh: str) -> str:
    """``old``: kept columns of existing rows; ``new`` and ``fresh``: of a changed key's and a new key's row."""
    gone = "NOT matched" if delete else "false"
    return f"""{_BASE}
SELECT {_T}, {old.format(gone=gone)} {_TM}
UNION ALL SELECT {_S}, {new} {_SM}
UNION ALL SELECT {_S}, {fresh} {_ANTI}"""


_VERSION = (f"{_B} AS {_C}, 1 AS WH_Version, CASE WHEN changed THEN 0 ELSE 1 END AS WH_isCurrent, CASE WHEN {{gone}} THEN 1 ELSE 0 END AS WH_isDeleted", f"{_N}, 2, 1, 0", f"{_N}, 1, 1, 0")
_DATED = f"{_B} AS {_C}, CASE WHEN changed OR {{gone}} THEN {_N} ELSE {_B} END AS {_M}, {{current}}CASE WHEN {{gone}} THEN 1 ELSE 0 END AS WH_isDeleted, {_B} AS WH_RowEffectiveDateTime_UTC, CASE WHEN changed THEN {_N} ELSE {_E} END AS WH_RowExpirationDateTime_UTC"
_dated = lambda current: _DATED.replace("{current}", "CASE WHEN changed THEN 0 ELSE 1 END AS WH_isCurrent, " if current else "")

SQL = {
    "scd1_merge": _scd1_sql(False),
    "scd1_merge_delete": _scd1_sql(True),
    "scd2_version_merge": _scd2_sql(False, *_VERSION),
    "scd2_version_softdelete": _scd2_sql(True, *_VERSION),
    "scd2_date_merge": _scd2_sql(True, _dated(False), f"{_N}, {_N}, 0, {_N}, {_E}", f"{_N}, {_N}, 0, {_N}, {_E}"),
    "scd2_date_current_merge": _scd2_sql(True, _dated(True), f"{_N}, {_N}, 1, 0, {_N}, {_E}", f"{_N}, {_N}, 1, 0, {_N}, {_E}"),
    "scd4_current": _scd1_sql(True, False),
    "scd4_history": f"{_BASE} SELECT {_T}, {_B} AS {_C} {_TM} WHERE changed OR NOT matched",
    "merge_actions": f"{_BASE} SELECT CASE WHEN changed THEN 'update' WHEN matched THEN 'keep' ELSE 'delete' END AS action, count(*) AS rows FROM m GROUP BY 1 UNION ALL SELECT 'insert', count(*) {_ANTI} HAVING count(*) > 0",
    "merge_configuration_checks": " UNION ALL ".join(
        f"SELECT dynamicmergeconfigurationid, '{n}' AS problem FROM mrg_dynamicmergeconfiguration WHERE {w}"
        for n, w in {
            "scdtype": "scdtype IS NULL OR scdtype NOT IN ('SCD1', 'SCD2Version', 'SCD2Date', 'SCD2DateAndCurrent', 'SCD4')",
            "qualifiedsourcename": "qualifiedsourcename IS NULL OR qualifiedsourcename NOT LIKE '%.%.%'",
            "qualifiedtargetname": "qualifiedtargetname IS NULL OR qualifiedtargetname NOT LIKE '%.%.%'",
            "qualifiedtargethistoryname": "qualifiedtargethistoryname NOT LIKE '%.%.%'",
            "mergeconfigurationname": "mergeconfigurationname IS NULL OR lower(mergeconfigurationname) IN (SELECT lower(mergeconfigurationname) FROM mrg_dynamicmergeconfiguration GROUP BY 1 HAVING count(*) > 1)",
            "mergeoncolumns": "length(trim(coalesce(mergeoncolumns, ''), ' ')) = 0",
        }.items()
    ),
}
