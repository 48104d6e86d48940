"""Queries over lineage, and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.lineage import exclusions as x
from loamwork.lineage.catalog import DEFINED, LISTED, expression_dependencies, object_definitions, object_list
from loamwork.lineage.closure import depth_limits, extended_dependencies
from loamwork.lineage.edges import cleanse, direct_dependencies
from loamwork.lineage.model import OBJECT, REFERENCED, REFERENCING, ROOT, SOURCE, TARGET
from loamwork.lineage.normalize import plain_space, remove_comments
from loamwork.lineage.parser import parsed_dependencies
from loamwork.lineage.reports import circular, cross_database, impact_levels, impact_summary, object_dependency, object_summary, orphaned, parsed_versus_expression
from loamwork.functions.names import key
from loamwork.sources.tables import table
from loamwork.storage import settle

#: LEVELS is the reference's default depth, in the queries and in their SQL.
SERVER, LEVELS, NOW = "WHALPHA", 30, dt.datetime(2025, 1, 1)
#: Sample exclusions: (server, database pattern) and (server, database, schema, object pattern).
DATABASES = [("WHGAMMA", "Quarry%"), (None, "Tariff0_")]
OBJECTS = [(None, None, None, "%[_]old"), ("WHBETA", None, "audit", "usp%")]


def _database_exclusions(spark: SparkSession) -> DataFrame:
    rows = [(n, s, p, None, 1, NOW, "sample") for n, (s, p) in enumerate(DATABASES, 1)]
    return x.add_defaults(spark.createDataFrame(rows, x.DATABASES), NOW, "sample")


def _object_exclusions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *names, None, 1, NOW, "sample") for n, names in enumerate(OBJECTS, 1)], x.OBJECTS)


def normal_edges(edges: DataFrame) -> DataFrame:
    """Direct dependencies with names in comparable form, once each."""
    names = [key(c).alias(c) for c in (*SOURCE, *TARGET)]
    return edges.select(*names, "sourcetype", "targettype").groupBy(*SOURCE, *TARGET).agg(F.min("sourcetype").alias("sourcetype"), F.min("targettype").alias("targettype"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return normal_edges(table(spark, d, "lng_objectdirectdependency"))


def _extended(spark: SparkSession, d: str, *directions: str) -> DataFrame:
    return extended_dependencies(settle(_edges(spark, d), "edges"), _object_exclusions(spark), LEVELS, directions or ("Downstream", "Upstream"))


def _deepest_root(extended: DataFrame) -> tuple[str | None, ...]:
    """The object the sample reports are about: the least name of those with the deepest path downstream."""
    down = extended.where("lineagedirection = 'Downstream'").select("lineagelevel", *ROOT)
    deepest = down.groupBy("lineagelevel").agg(F.min(F.struct(*ROOT)).alias("root")).orderBy(F.desc("lineagelevel")).first()
    return tuple(deepest["root"]) if deepest else ("", "", "", "")


def lineage_objects(spark: SparkSession, d: str) -> DataFrame:
    return object_list(table(spark, d, "lng_objectlist"), _database_exclusions(spark)).select("objectid", "objectname", "fullobjectname").distinct()


def lineage_definitions(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "lng_objectdefinitions").select("objectid", "objectdefinition")
    found = object_definitions(table(spark, d, "lng_objectlist"), remove_comments(texts))
    return found.select("objectid", *OBJECT, plain_space("objectdefinition").alias("objectdefinition"))


def lineage_expression(spark: SparkSession, d: str) -> DataFrame:
    found = expression_dependencies(table(spark, d, "lng_objectexpressiondependency"), _database_exclusions(spark))
    return found.select("expressiondependencyid", *REFERENCED)


def lineage_parsed(spark: SparkSession, d: str) -> DataFrame:
    return parsed_dependencies(remove_comments(table(spark, d, "lng_objectdefinitions")))


def _cleansed(spark: SparkSession, d: str) -> DataFrame:
    return cleanse(settle(lineage_parsed(spark, d), "parsed"), table(spark, d, "lng_objectlist"), SERVER)


def _lowered(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: key(c) for c in columns})


def lineage_cleansed(spark: SparkSession, d: str) -> DataFrame:
    return _lowered(_cleansed(spark, d), [*SOURCE, "operationtype", *TARGET])


def lineage_direct(spark: SparkSession, d: str) -> DataFrame:
    return _lowered(direct_dependencies(_cleansed(spark, d), table(spark, d, "lng_objectlist")), [*SOURCE, *TARGET]).distinct()


def lineage_down(spark: SparkSession, d: str) -> DataFrame:
    return _extended(spark, d, "Downstream")


def lineage_up(spark: SparkSession, d: str) -> DataFrame:
    return _extended(spark, d, "Upstream")


def lineage_limits(spark: SparkSession, d: str) -> DataFrame:
    return depth_limits(_extended(spark, d), LEVELS)


def object_dependency_report(spark: SparkSession, d: str) -> DataFrame:
    extended = settle(_extended(spark, d), "extended")
    return object_dependency(extended, _deepest_root(extended))


def impact_by_level(spark: SparkSession, d: str) -> DataFrame:
    extended = settle(_extended(spark, d, "Downstream"), "extended")
    return impact_levels(extended, _deepest_root(extended))


def impact_total(spark: SparkSession, d: str) -> DataFrame:
    extended = settle(_extended(spark, d, "Downstream"), "extended")
    return impact_summary(extended, _deepest_root(extended))


def cross_database_report(spark: SparkSession, d: str) -> DataFrame:
    return cross_database(_edges(spark, d))


def circular_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return circular(_edges(spark, d))


def orphaned_objects(spark: SparkSession, d: str) -> DataFrame:
    return orphaned(table(spark, d, "lng_objectlist"), table(spark, d, "lng_objectdirectdependency"))


def object_summaries(spark: SparkSession, d: str) -> DataFrame:
    found = object_summary(table(spark, d, "lng_objectlist"), table(spark, d, "lng_objectdirectdependency"))
    return found.select("objectid", *OBJECT, "dependsoncount", "dependedbycount", "totaldependencies")


def parsed_versus_expression_report(spark: SparkSession, d: str) -> DataFrame:
    found = parsed_versus_expression(settle(lineage_parsed(spark, d), "parsed"), table(spark, d, "lng_objectexpressiondependency"), table(spark, d, "lng_objectlist"))
    return _lowered(found, [*SOURCE, *TARGET]).distinct()


def database_exclusions_list(spark: SparkSession, d: str) -> DataFrame:
    changed = x.remove(x.add(_database_exclusions(spark), NOW, "sample", "rebuilt", servername="WHBETA", databasename="Stock%"), servername="WHGAMMA", databasename="quarry%")
    return x.listed(changed).select("exclusionid", "servername", "databasename", "isactive")


def object_exclusions_list(spark: SparkSession, d: str) -> DataFrame:
    changed = x.remove(x.add(_object_exclusions(spark), NOW, "sample", databasename="Stock00", objectname="tmp%"), exclusion_id=2)
    return x.listed(changed).select("exclusionid", *OBJECT)


QUERIES = {
    f.__name__: f
    for f in (
        lineage_objects, lineage_definitions, lineage_expression, lineage_parsed, lineage_cleansed, lineage_direct, lineage_down, lineage_up, lineage_limits,
        object_dependency_report, impact_by_level, impact_total, cross_database_report, circular_dependencies, orphaned_objects, object_summaries,
        parsed_versus_expression_report, database_exclusions_list, object_exclusions_list,
    )
}

_K = lambda c: f"lower(trim({c}, ' '))"
_LIST = ", ".join
_NAME = lambda cols: " || chr(31) || ".join(_K(c) for c in cols)
_EXCLUDED_DB = lambda s, d: f"({_K(d)} IN ('master', 'tempdb', 'model', 'msdb') OR ({_K(s)} = 'whgamma' AND {_K(d)} LIKE 'quarry%') OR {_K(d)} LIKE 'tariff0_')"
_EXCLUDED_OBJECT = lambda p: f"(right({p}object, 4) = '_old' OR ({p}server = 'whbeta' AND {p}schema = 'audit' AND starts_with({p}object, 'usp')))"
_QUOTED = lambda names: _LIST(f"'{n}'" for n in names)
_PLAIN = r"trim(regexp_replace(regexp_replace(objectdefinition, '([;),])', ' \1', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ')"

_PARSED = rf"""
t AS (SELECT *, {_PLAIN} AS t FROM lng_objectdefinitions WHERE objectdefinition IS NOT NULL),
m AS (SELECT *, unnest(regexp_extract_all(t, '(?i) (?:from|join|insert into) [^ ,(]+')) AS hit FROM t),
r AS (SELECT *, string_split(replace(replace(regexp_extract(hit, '[^ ]+$'), '[', ''), ']', ''), '.') AS p, CASE WHEN starts_with(lower(hit), ' insert') THEN 'INSERT' ELSE 'SELECT' END AS operationtype FROM m),
parsed AS (SELECT servername AS sourceserver, databasename AS sourcedatabase, schemaname AS sourceschema, objectname AS sourceobject, operationtype,
  coalesce(p[-4], servername) AS targetserver, coalesce(p[-3], databasename) AS targetdatabase, coalesce(p[-2], 'dbo') AS targetschema, p[-1] AS targetobject FROM r)
"""
_CLEANSED = f"""{_PARSED},
known AS (SELECT DISTINCT {_NAME(OBJECT)} AS n FROM lng_objectlist),
lowered AS (SELECT DISTINCT {_LIST(f'{_K(c)} AS {c}' for c in (*SOURCE, 'operationtype', *TARGET))} FROM parsed),
kept AS (SELECT * FROM lowered WHERE targetserver <> '{SERVER.lower()}' OR {_NAME(TARGET)} IN (SELECT n FROM known)),
cleansed AS (SELECT {_LIST(f"CASE WHEN operationtype IN ('select', 'execute') THEN {b} ELSE {a} END AS {a}" for a, b in zip(SOURCE, TARGET, strict=True))}, operationtype,
  {_LIST(f"CASE WHEN operationtype IN ('select', 'execute') THEN {b} ELSE {a} END AS {a}" for a, b in zip(TARGET, SOURCE, strict=True))} FROM kept)
"""
_EDGES = f"edges AS (SELECT {_LIST(f'{_K(c)} AS {c}' for c in (*SOURCE, *TARGET))}, min(sourcetype) AS sourcetype, min(targettype) AS targettype FROM lng_objectdirectdependency GROUP BY {_LIST(_K(c) for c in (*SOURCE, *TARGET))})"
_DOT = lambda p: f"concat_ws('.', {p}server, {p}database, {p}schema, {p}object)"


def _closure_sql(down: bool) -> str:
    near, far, arrow = ("source", "target", " -> ") if down else ("target", "source", " <- ")
    parts = ("server", "database", "schema", "object")
    name = "Downstream" if down else "Upstream"
    return f"""
{name.lower()}_hops AS (SELECT *, {_DOT(near)} AS a, {_DOT(far)} AS b FROM edges WHERE NOT {_EXCLUDED_OBJECT(far)}),
{name.lower()}_r AS (SELECT {_LIST(f'{near}{p} AS root{p}' for p in parts)}, {near}type AS rootobjecttype, {_LIST(f'{far}{p} AS dependent{p}' for p in parts)}, {far}type AS dependentobjecttype, a || '{arrow}' || b AS lineagepath, 1 AS lineagelevel, b AS last, [a, b] AS onpath FROM {name.lower()}_hops
 UNION ALL SELECT {_LIST(f'r.root{p}' for p in parts)}, r.rootobjecttype, {_LIST(f'h.{far}{p}' for p in parts)}, h.{far}type, r.lineagepath || '{arrow}' || h.b, r.lineagelevel + 1, h.b, list_append(r.onpath, h.b)
 FROM {name.lower()}_r r JOIN {name.lower()}_hops h ON r.last = h.a WHERE r.lineagelevel < {LEVELS} AND NOT list_contains(r.onpath, h.b)),
{name.lower()} AS (SELECT DISTINCT {_LIST(f'root{p}' for p in parts)}, rootobjecttype, {_LIST(f'dependent{p}' for p in parts)}, dependentobjecttype, lineagepath, lineagelevel, '{name}' AS lineagedirection FROM {name.lower()}_r)"""


_DOWN, _UP = _closure_sql(True), _closure_sql(False)
_ROOTS = "rootserver, rootdatabase, rootschema, rootobject"
_FIRST = f"f AS (SELECT min(row({_ROOTS})) AS n FROM downstream WHERE lineagelevel = (SELECT max(lineagelevel) FROM downstream))"
_ROOTED = f"row({_ROOTS}) = (SELECT n FROM f)"
_OTHER = f"{_NAME(SOURCE)} <> {_NAME(TARGET)} AND NOT starts_with({_K('sourceobject')}, 'ck') AND {_NAME(TARGET)} IN (SELECT n FROM known)"

SQL = {
    "lineage_objects": f"SELECT DISTINCT objectid, objectname, concat_ws('.', coalesce(databasename, ''), coalesce(schemaname, ''), coalesce(objectname, '')) AS fullobjectname FROM lng_objectlist WHERE {_K('objecttype')} IN ({_QUOTED(t.lower() for t in LISTED)}) AND NOT {_EXCLUDED_DB('servername', 'databasename')}",
    "lineage_definitions": f"SELECT o.*, {_PLAIN} AS objectdefinition FROM (SELECT DISTINCT objectid, {_LIST(OBJECT)} FROM (SELECT DISTINCT objectid, {_LIST(OBJECT)}, objecttype FROM lng_objectlist WHERE {_K('objecttypename')} IN ({_QUOTED(t.lower() for t in DEFINED)}))) o JOIN (SELECT objectid, objectdefinition FROM lng_objectdefinitions) t USING (objectid)",
    "lineage_expression": f"WITH e AS (SELECT expressiondependencyid, coalesce(referenced_server_name, referencingserver) AS referenced_server_name, coalesce(referenced_database_name, referencingdatabase) AS referenced_database_name, coalesce(referenced_schema_name, 'dbo') AS referenced_schema_name, referenced_entity_name FROM lng_objectexpressiondependency) SELECT * FROM e WHERE NOT {_EXCLUDED_DB('referenced_server_name', 'referenced_database_name')}",
    "lineage_parsed": f"WITH {_PARSED} SELECT * FROM parsed",
    "lineage_cleansed": f"WITH {_CLEANSED} SELECT * FROM cleansed",
    "lineage_direct": f"""WITH {_CLEANSED}, kinds AS (SELECT {_NAME(OBJECT)} AS n, min(trim(objecttype, ' ')) AS k FROM lng_objectlist GROUP BY 1)
SELECT DISTINCT {_LIST(SOURCE)}, coalesce(a.k, 'UNKNOWN') AS sourcetype, {_LIST(TARGET)}, coalesce(b.k, 'UNKNOWN') AS targettype FROM cleansed LEFT JOIN kinds a ON a.n = {_NAME(SOURCE)} LEFT JOIN kinds b ON b.n = {_NAME(TARGET)}""",
    "lineage_down": f"WITH RECURSIVE {_EDGES}, {_DOWN} SELECT * FROM downstream",
    "lineage_up": f"WITH RECURSIVE {_EDGES}, {_UP} SELECT * FROM upstream",
    "lineage_limits": f"WITH RECURSIVE {_EDGES}, {_DOWN}, {_UP} SELECT DISTINCT {_ROOTS}, lineagedirection, {LEVELS} AS maxlevel FROM (FROM downstream UNION ALL FROM upstream) WHERE lineagelevel = {LEVELS}",
    "object_dependency_report": f"WITH RECURSIVE {_EDGES}, {_DOWN}, {_UP}, {_FIRST} SELECT * EXCLUDE ({_ROOTS}, rootobjecttype) FROM (FROM downstream UNION ALL FROM upstream) WHERE {_ROOTED}",
    "impact_by_level": f"WITH RECURSIVE {_EDGES}, {_DOWN}, {_FIRST} SELECT lineagelevel, count(DISTINCT {_DOT('dependent')}) AS affectedobjectcount, string_agg({_DOT('dependent')}, ', ' ORDER BY {_DOT('dependent')}) AS affectedobjects FROM downstream WHERE {_ROOTED} GROUP BY 1",
    "impact_total": f"WITH RECURSIVE {_EDGES}, {_DOWN}, {_FIRST} SELECT count(DISTINCT {_DOT('dependent')}) AS totalaffectedobjects, max(lineagelevel) AS maxdependencydepth FROM downstream WHERE {_ROOTED}",
    "cross_database_report": f"WITH {_EDGES} SELECT *, CASE WHEN sourceserver <> targetserver THEN 'Cross-Server' ELSE 'Cross-Database' END AS scope FROM edges WHERE sourceserver <> targetserver OR sourcedatabase <> targetdatabase",
    "circular_dependencies": f"WITH {_EDGES} SELECT DISTINCT {_LIST(SOURCE)}, {_LIST(TARGET)}, 'Circular Reference Detected' AS issue FROM edges a WHERE EXISTS (SELECT 1 FROM edges b WHERE {' AND '.join(f'a.{s} = b.{t} AND a.{t} = b.{s}' for s, t in zip(SOURCE, TARGET, strict=True))})",
    "orphaned_objects": f"SELECT * FROM lng_objectlist WHERE {_NAME(OBJECT)} NOT IN (SELECT {_NAME(SOURCE)} FROM lng_objectdirectdependency UNION ALL SELECT {_NAME(TARGET)} FROM lng_objectdirectdependency)",
    "object_summaries": f"""WITH o AS (SELECT {_NAME(SOURCE)} AS n, count(*) AS c FROM lng_objectdirectdependency GROUP BY 1), i AS (SELECT {_NAME(TARGET)} AS n, count(*) AS c FROM lng_objectdirectdependency GROUP BY 1)
SELECT objectid, {_LIST(OBJECT)}, coalesce(o.c, 0) AS dependsoncount, coalesce(i.c, 0) AS dependedbycount, coalesce(o.c, 0) + coalesce(i.c, 0) AS totaldependencies FROM lng_objectlist LEFT JOIN o ON o.n = {_NAME(OBJECT)} LEFT JOIN i ON i.n = {_NAME(OBJECT)}""",
    "parsed_versus_expression_report": f"""WITH {_PARSED}, known AS (SELECT DISTINCT {_NAME(OBJECT)} AS n FROM lng_objectlist),
p AS (SELECT DISTINCT {_LIST(f'{_K(c)} AS {c}' for c in SOURCE)}, operationtype, {_LIST(f'{_K(c)} AS {c}' for c in TARGET)} FROM parsed WHERE {_OTHER}),
e AS (SELECT DISTINCT {_LIST(f'{_K(a)} AS {b}' for a, b in zip(REFERENCING, SOURCE, strict=True))}, CAST(NULL AS VARCHAR) AS operationtype, {_LIST(f'{_K(a)} AS {b}' for a, b in zip(REFERENCED, TARGET, strict=True))} FROM lng_objectexpressiondependency),
ek AS (SELECT * FROM e WHERE {_OTHER})
SELECT 'ParsedOnly' AS comparisonresult, * FROM p WHERE {_NAME(SOURCE)} || chr(30) || {_NAME(TARGET)} NOT IN (SELECT {_NAME(SOURCE)} || chr(30) || {_NAME(TARGET)} FROM ek)
UNION ALL SELECT 'ExpressionOnly', * FROM ek WHERE {_NAME(SOURCE)} || chr(30) || {_NAME(TARGET)} NOT IN (SELECT {_NAME(SOURCE)} || chr(30) || {_NAME(TARGET)} FROM p)""",
    "database_exclusions_list": "SELECT CAST(e AS BIGINT) AS exclusionid, s AS servername, d AS databasename, 1 AS isactive FROM (VALUES (2, NULL, 'Tariff0_'), (3, NULL, 'master'), (4, NULL, 'tempdb'), (5, NULL, 'model'), (6, NULL, 'msdb'), (7, 'WHBETA', 'Stock%')) v(e, s, d)",
    "object_exclusions_list": "SELECT CAST(e AS BIGINT) AS exclusionid, CAST(NULL AS VARCHAR) AS servername, d AS databasename, CAST(NULL AS VARCHAR) AS schemaname, o AS objectname FROM (VALUES (1, NULL, '%[_]old'), (3, 'Stock00', 'tmp%')) v(e, d, o)",
}
