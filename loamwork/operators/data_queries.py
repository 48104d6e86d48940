"""Queries over the data-processing operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.names import full_key
from loamwork.operators.hierarchy import descendants, hierarchy
from loamwork.operators.load_profile import CUSTOMER_LOADS, ProfileStore
from loamwork.operators.orphans import object_orphans
from loamwork.operators.packed_fields import split_fields
from loamwork.operators.snapshots import snapshot_changes
from loamwork.sources.tables import table
from loamwork.storage import settle

SOURCE, TARGET = (["sourceserver", "sourcedatabase", "sourceschema", "sourceobject"], ["targetserver", "targetdatabase", "targetschema", "targetobject"])
COMPARED = ["dateofbirth", "firstname", "lastname", "email", "country", "age", "loyaltypoints"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lng_objectdirectdependency")
    return descendants(edges, full_key(*SOURCE), full_key(*TARGET)).select(F.col("ancestor").alias("ancestorname"), F.col("descendant").alias("descendantname"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "lng_objectdirectdependency"), full_key(*SOURCE), full_key(*TARGET))


def p3_orphans(spark: SparkSession, d: str) -> DataFrame:
    return object_orphans(table(spark, d, "lng_objectexpressiondependency"), table(spark, d, "lng_objectlist"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_orphans(spark, d).where("orphan_kind = 'direct'").select("expressiondependencyid")


def p3_by_period(spark: SparkSession, d: str) -> DataFrame:
    kinds = p3_orphans(spark, d).groupBy("referencedobjecttype", F.date_trunc("month", "capturedate").alias("month"))
    return kinds.agg(F.count_if(F.expr("orphan_kind = 'direct'")).alias("direct"), F.count_if(F.expr("orphan_kind = 'inherited'")).alias("inherited"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "mrg_scd1_source"), "feedcode", "snapshotno", "customerid", "deliveredat", "sourcerowid", COMPARED)


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("feedcode", "snapshotno").agg(*(F.count_if(F.col("changekind") == k).alias(k) for k in ("added", "removed", "changed")))


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of all loads, from a store that is kept no longer."""
    store = ProfileStore(spark, CUSTOMER_LOADS)
    store.add(table(spark, d, "mrg_scd1_source"))
    metrics = settle(store.metrics(), "metrics")
    store.store.destroy()
    return metrics


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return CUSTOMER_LOADS.findings(_profiled(spark, d), table(spark, d, "gen_objectdataprofile"))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profiled(spark, d).select("feedcode", "snapshotno", "columnname", "total", "nulls", "distincts", "mode_n")


def p5_load_profile(spark: SparkSession, d: str) -> DataFrame:
    return CUSTOMER_LOADS.profile(table(spark, d, "mrg_scd1_source"))


def p5_control_limits(spark: SparkSession, d: str) -> DataFrame:
    return CUSTOMER_LOADS.control_limits(_profiled(spark, d)).select("feedcode", "snapshotno", "columnname", "metric", *(F.round(c, 6).alias(c) for c in ("value", "mean", "deviation")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split_fields(table(spark, d, "mrg_dynamicmergeconfiguration"), "dynamicmergeconfigurationid", ["mergeoncolumns", "ignorecolumns"])


#: Rows with stray or missing marks, beside clean ones that hold the names: (id, merge on, ignored, its names).
DAMAGED = [
    (-1, "[Client Rate]; 'Sale, Date'", "`Other| Name`", (["Client Rate", "Sale, Date"], ["Other| Name"])),
    (-2, "[Client Rate; Foo", "x, Sale, Date'", (["Client Rate", "Foo"], ["x", "Sale, Date"])),
    (-3, "`other| name, [Client Rate]", "Client Rate, Foo", (["other| name", "Client Rate"], ["Client", "Rate", "Foo"])),
    (-4, "a; Other| Name` | b", "'sale, date ; c", (["a", "Other| Name", "b"], ["sale, date", "c"])),
    (-5, "[Unknown Name; d", None, (["Unknown", "Name", "d"], [])),
]


def p6_damaged(spark: SparkSession, d: str) -> DataFrame:
    """All fields and some damaged ones, in which the dictionary decides."""
    stored = table(spark, d, "mrg_dynamicmergeconfiguration").select("dynamicmergeconfigurationid", "mergeoncolumns", "ignorecolumns")
    return split_fields(stored.union(spark.createDataFrame([r[:3] for r in DAMAGED], stored.schema)), "dynamicmergeconfigurationid", ["mergeoncolumns", "ignorecolumns"])


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p3_found, p3_orphans, p3_by_period, p4_found, p4_summary, p5_found, p5_profile, p5_load_profile, p5_control_limits, p6_found, p6_damaged)}

_name = lambda p: "||'.'||".join(f"lower(trim({c}, ' '))" for c in p)

_EDGES = f"edges AS (SELECT DISTINCT {_name(SOURCE)} AS src, {_name(TARGET)} AS dst FROM lng_objectdirectdependency)"

_P3 = """
WITH refs AS (SELECT *, {ref} AS refname FROM lng_objectexpressiondependency),
objs AS (SELECT *, {obj} AS objname FROM lng_objectlist),
by_id AS (SELECT DISTINCT r.expressiondependencyid FROM refs r JOIN objs o ON r.referenced_id = o.objectid
  AND (r.capturedate IS NULL OR (coalesce(o.createdate <= r.capturedate, true) AND coalesce(r.capturedate < o.dropdate, true)))),
by_name AS (SELECT DISTINCT r.expressiondependencyid FROM refs r JOIN objs o ON r.referenced_id IS NULL AND r.refname = o.objname
  AND (r.capturedate IS NULL OR (coalesce(o.createdate <= r.capturedate, true) AND coalesce(r.capturedate < o.dropdate, true))))
SELECT expressiondependencyid FROM refs WHERE expressiondependencyid NOT IN (SELECT * FROM by_id UNION ALL SELECT * FROM by_name)
""".format(ref=_name(["referenced_server_name", "referenced_database_name", "referenced_schema_name", "referenced_entity_name"]), obj=_name(["servername", "databasename", "schemaname", "objectname"]))

_TEXT = lambda c: f"lower(trim({c}, ' '))" if c in ("firstname", "lastname", "email", "country") else f"CAST({c} AS VARCHAR)"

_P4 = f"""
WITH r AS (SELECT feedcode, snapshotno, customerid, row({', '.join(_TEXT(c) for c in COMPARED)}) AS v,
  row_number() OVER (PARTITION BY feedcode, snapshotno, customerid ORDER BY deliveredat DESC NULLS LAST, sourcerowid DESC) AS k FROM mrg_scd1_source),
cur AS (SELECT * FROM r WHERE k = 1),
s AS (SELECT feedcode, snapshotno, lead(snapshotno) OVER (PARTITION BY feedcode ORDER BY snapshotno) AS later FROM (SELECT DISTINCT feedcode, snapshotno FROM mrg_scd1_source)),
a AS (SELECT s.feedcode, s.later AS snapshotno, customerid, v FROM cur JOIN s USING (feedcode, snapshotno) WHERE s.later IS NOT NULL),
b AS (SELECT feedcode, snapshotno, customerid, v FROM cur WHERE (feedcode, snapshotno) IN (SELECT (feedcode, later) FROM s WHERE later IS NOT NULL))
SELECT coalesce(a.feedcode, b.feedcode) AS feedcode, coalesce(a.snapshotno, b.snapshotno) AS snapshotno, coalesce(a.customerid, b.customerid) AS customerid,
  CASE WHEN a.feedcode IS NULL THEN 'added' WHEN b.feedcode IS NULL THEN 'removed' ELSE 'changed' END AS changekind
FROM a FULL OUTER JOIN b ON a.feedcode = b.feedcode AND a.snapshotno = b.snapshotno AND a.customerid = b.customerid
WHERE a.feedcode IS NULL OR b.feedcode IS NULL OR a.v IS DISTINCT FROM b.v
"""

_COLS = CUSTOMER_LOADS.columns
_METRICS = "m AS (" + " UNION ALL ".join(
    f"SELECT feedcode, snapshotno, '{c}' AS columnname, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS BIGINT) AS nulls, count(v) AS distincts, CAST(coalesce(max(n) FILTER (WHERE v IS NOT NULL), 0) AS BIGINT) AS mode_n"
    f" FROM (SELECT feedcode, snapshotno, {_TEXT(c)} AS v, count(*) AS n FROM mrg_scd1_source GROUP BY ALL) GROUP BY feedcode, snapshotno"
    for c in _COLS
) + ")"

_VIOLATED = {
    ("email", "pattern"): r"NOT regexp_matches(trim(email, ' '), '^[^@\s]+@[^@\s]+\.[^@\s]+$')",
    **{(c, "pattern"): rf"regexp_matches({c}, '[\p{{Nd}}\x00-\x1f]')" for c in ("firstname", "lastname", "country")},
    ("age", "range"): "age NOT BETWEEN 0 AND 120",
    ("loyaltypoints", "range"): "loyaltypoints < 0",
    ("dateofbirth", "range"): "dateofbirth < DATE '1900-01-01' OR dateofbirth > snapshotdate",
    **{(c, "maxlength"): f"length(rtrim({c}, ' ')) >= {n}" for c, n in CUSTOMER_LOADS.declared.items()},
}

_VIOLATIONS = lambda c, f: f"count(*) FILTER (WHERE {_VIOLATED[c, f]})" if (c, f) in _VIOLATED else "CAST(NULL AS BIGINT)"
_REACHED = lambda c: f"CAST(coalesce(max(length(rtrim({c}, ' '))), 0) >= {CUSTOMER_LOADS.declared[c]} AS INTEGER)" if c in CUSTOMER_LOADS.declared else "CAST(NULL AS INTEGER)"
_IS_TEXT = lambda c: _TEXT(c).startswith("lower")
_LOAD_PROFILE = " UNION ALL ".join(
    f"SELECT g.*, m.v AS mode, coalesce(m.n, 0) AS mode_n FROM (SELECT feedcode, snapshotno, '{c}' AS columnname, count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {_TEXT(c)}) AS distincts,"
    f" CAST(min({_TEXT(c) if _IS_TEXT(c) else c}) AS VARCHAR) AS minvalue, CAST(max({_TEXT(c) if _IS_TEXT(c) else c}) AS VARCHAR) AS maxvalue,"
    f" {f"CAST(max(length(rtrim({c}, ' '))) AS INTEGER)" if _IS_TEXT(c) else 'CAST(NULL AS INTEGER)'} AS longest, {_REACHED(c)} AS lengthreached, {_VIOLATIONS(c, 'pattern')} AS patterns, {_VIOLATIONS(c, 'range')} AS outofrange FROM mrg_scd1_source GROUP BY feedcode, snapshotno) g"
    f" LEFT JOIN (SELECT feedcode, snapshotno, {_TEXT(c)} AS v, count(*) AS n FROM mrg_scd1_source WHERE {c} IS NOT NULL GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY feedcode, snapshotno ORDER BY n DESC, v DESC) = 1) m"
    " ON m.feedcode IS NOT DISTINCT FROM g.feedcode AND m.snapshotno IS NOT DISTINCT FROM g.snapshotno"
    for c in _COLS
)

_P5 = f"""
WITH {_METRICS},
viol AS ({' UNION ALL '.join(f"SELECT DISTINCT feedcode, snapshotno, '{c}' AS columnname, '{f}' AS finding FROM mrg_scd1_source WHERE {w}" for (c, f), w in _VIOLATED.items())}),
w AS (SELECT *, lag(total) OVER o AS pt, lag(nulls) OVER o AS pn, lag(mode_n) OVER o AS pm, lag(distincts) OVER o AS pd FROM m WINDOW o AS (PARTITION BY feedcode, columnname ORDER BY snapshotno))
SELECT * FROM viol
UNION ALL SELECT feedcode, snapshotno, columnname, 'nulls' FROM w WHERE abs(nulls * pt - pn * total) * 1000 > 107 * total * pt
UNION ALL SELECT feedcode, snapshotno, columnname, 'mode' FROM w WHERE abs(mode_n * pt - pm * total) * 1000 > 107 * total * pt
UNION ALL SELECT feedcode, snapshotno, columnname, 'distinct' FROM w WHERE abs(distincts - pd) * 2 > pd
UNION ALL SELECT DISTINCT g.feedcode, g.snapshotno, g.columnname, 'misreported' FROM gen_objectdataprofile g JOIN m USING (feedcode, snapshotno, columnname)
  LEFT JOIN (SELECT feedcode, snapshotno, columnname, 1 AS hit FROM viol WHERE finding = 'maxlength') x USING (feedcode, snapshotno, columnname)
  WHERE g.nullvalues IS DISTINCT FROM m.nulls OR g.distinctvalues IS DISTINCT FROM m.distincts
  OR g.maxlengthreached IS DISTINCT FROM (CASE WHEN columnname IN ({', '.join(f"'{c}'" for c in CUSTOMER_LOADS.declared)}) THEN coalesce(hit, 0) END)
"""

_LIMITS = f"""
WITH {_METRICS},
l AS (SELECT feedcode, snapshotno, columnname, 'null_share' AS metric, nulls / total AS value FROM m
  UNION ALL SELECT feedcode, snapshotno, columnname, 'distinct_share', distincts / total FROM m
  UNION ALL SELECT feedcode, snapshotno, columnname, 'mode_share', mode_n / total FROM m),
w AS (SELECT *, avg(value) OVER o AS mean, stddev_pop(value) OVER o AS deviation, count(value) OVER o AS former FROM l
  WINDOW o AS (PARTITION BY feedcode, columnname, metric ORDER BY snapshotno ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT feedcode, snapshotno, columnname, metric, round(value, 6) AS value, round(mean, 6) AS mean, round(deviation, 6) AS deviation
FROM w WHERE former >= 3 AND abs(value - mean) > 3.0 * deviation + 1e-9
"""

_MARKED = {"[": "]", '"': '"', "\'\'": "\'\'", "`": "`"}  # as they stand within an SQL string
_TOKENS = "|".join(rf"\{a}(?:[^\{b}]|\{b}\{b})*\{b}" if a == "[" else f"{a}(?:[^{b}]|{b}{b})*{b}" for a, b in _MARKED.items()) + r"|[\p{L}\p{M}\p{Nd}_$#@]+"
_INNER = " ".join(f"WHEN '{a}' THEN replace(h[2:-2], '{b}{b}', '{b}')" for a, b in _MARKED.items())
_P6 = f"""
WITH f AS (SELECT dynamicmergeconfigurationid, 'mergeoncolumns' AS fieldname, mergeoncolumns AS t FROM mrg_dynamicmergeconfiguration
  UNION ALL SELECT dynamicmergeconfigurationid, 'ignorecolumns', ignorecolumns FROM mrg_dynamicmergeconfiguration),
m AS (SELECT dynamicmergeconfigurationid, fieldname, list_filter(regexp_extract_all(t, '{_TOKENS}'), lambda h: h NOT IN ('[]', '""', '\'\'\'\'', '``')) AS hits FROM f WHERE t IS NOT NULL),
e AS (SELECT dynamicmergeconfigurationid, fieldname, unnest(hits) AS h, unnest(range(1, len(hits) + 1)) AS p FROM m)
SELECT dynamicmergeconfigurationid, fieldname, CAST(p AS INTEGER) AS valueposition, CASE h[1] {_INNER} ELSE h END AS columnvalue FROM e
"""

_MENDED = ", ".join(f"({r[0]}, '{f}', {p}, '{v}')" for r in DAMAGED for f, names in zip(("mergeoncolumns", "ignorecolumns"), r[3], strict=True) for p, v in enumerate(names, 1))

_WALK = lambda name, start: f"""{name}(node, root, depth, path) USING KEY (node) AS (SELECT n, n, 0, n FROM {start}
 UNION SELECT e.dst, arg_min(w.root, w.path), min(w.depth) + 1, min(w.path) || ' -> ' || e.dst FROM {name} w JOIN edges e ON w.node = e.src WHERE e.dst NOT IN (SELECT node FROM recurring.{name}) GROUP BY e.dst)"""  # noqa: E731
_P1_HIERARCHY = f"""
WITH RECURSIVE {_EDGES},
c AS (SELECT src AS a, dst AS d FROM edges UNION SELECT c.a, e.dst FROM c JOIN edges e ON c.d = e.src),
nodes AS (SELECT src AS n FROM edges UNION SELECT dst FROM edges),
roots AS (SELECT n FROM nodes WHERE n NOT IN (SELECT dst FROM edges WHERE src <> dst)),
{_WALK('w1', 'roots')},
unreached AS (SELECT n FROM nodes WHERE n NOT IN (SELECT node FROM w1)),
mutual AS (SELECT x.a, x.d FROM c x JOIN c y ON x.a = y.d AND x.d = y.a),
entries AS (SELECT a AS n FROM mutual WHERE a IN (SELECT n FROM unreached) AND a NOT IN (SELECT c.d FROM c LEFT JOIN mutual m ON c.a = m.a AND c.d = m.d WHERE m.a IS NULL) GROUP BY a HAVING min(d) = a),
{_WALK('w2', 'entries')},
w AS (FROM w1 UNION ALL SELECT * FROM w2 WHERE node NOT IN (SELECT node FROM w1))
SELECT w.node, w.root, w.depth, w.path, coalesce(b.n, 0) AS descendants, coalesce(b.y, 0) AS on_cycle
FROM w LEFT JOIN (SELECT a, count(*) AS n, max(CASE WHEN a = d THEN 1 ELSE 0 END) AS y FROM c GROUP BY a) b ON b.a = w.node
"""

_REFERENCED = ["referenced_server_name", "referenced_database_name", "referenced_schema_name", "referenced_entity_name"]
_REFERENCING = ["referencingserver", "referencingdatabase", "referencingschema", "referencingobject"]
_HOPS = f"""
WITH RECURSIVE d AS ({_P3}),
r AS (SELECT *, coalesce('i' || referenced_id, 'n' || {_name(_REFERENCED)}) AS k, ['i' || referencingobjectid, 'n' || {_name(_REFERENCING)}] AS owners FROM lng_objectexpressiondependency),
e AS (SELECT DISTINCT k, unnest(owners) AS o FROM r),
t(k, hop) USING KEY (k) AS (SELECT DISTINCT unnest(owners), 0 FROM r WHERE expressiondependencyid IN (FROM d)
 UNION SELECT e.o, min(t.hop) + 1 FROM t JOIN e ON e.k = t.k WHERE e.o NOT IN (SELECT k FROM recurring.t) GROUP BY e.o),
h AS (SELECT expressiondependencyid, referencedobjecttype, capturedate, CASE WHEN expressiondependencyid IN (FROM d) THEN 0 ELSE t.hop + 1 END AS hop FROM r LEFT JOIN t USING (k))
"""
_P3_ORPHANS = f"{_HOPS} SELECT *, CASE WHEN hop = 0 THEN 'direct' ELSE 'inherited' END AS orphan_kind FROM h WHERE hop IS NOT NULL"

SQL = {
    "p1_hierarchy": _P1_HIERARCHY,
    "p3_orphans": _P3_ORPHANS,
    "p3_by_period": f"SELECT referencedobjecttype, date_trunc('month', capturedate) AS month, count(*) FILTER (WHERE orphan_kind = 'direct') AS direct, count(*) FILTER (WHERE orphan_kind = 'inherited') AS inherited FROM ({_P3_ORPHANS}) GROUP BY ALL",
    "p6_found": _P6,
    "p6_damaged": f"{_P6} UNION ALL SELECT * FROM (VALUES {_MENDED}) v(a, b, c, d)",
    "p1_found": f"WITH RECURSIVE {_EDGES}, c AS (SELECT src AS ancestorname, dst AS descendantname FROM edges UNION SELECT c.ancestorname, e.dst FROM c JOIN edges e ON c.descendantname = e.src) SELECT * FROM c",
    "p3_found": _P3,
    "p4_found": _P4,
    "p4_summary": f"SELECT feedcode, snapshotno, {', '.join(f"count(*) FILTER (WHERE changekind = '{k}') AS {k}" for k in ('added', 'removed', 'changed'))} FROM ({_P4}) GROUP BY ALL",
    "p5_found": _P5,
    "p5_profile": f"WITH {_METRICS} SELECT * FROM m",
    "p5_load_profile": _LOAD_PROFILE,
    "p5_control_limits": _LIMITS,
}
