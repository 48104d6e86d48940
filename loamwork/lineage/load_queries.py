"""Queries over all kinds of statements, comments, merges as edges and the full load, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.names import key
from loamwork.lineage.batch import full_load
from loamwork.lineage.catalog import DEFINED, LISTED
from loamwork.lineage.closure import OUT
from loamwork.lineage.edges import direct_dependencies
from loamwork.lineage.model import OBJECT, SOURCE, TARGET
from loamwork.lineage.normalize import plain_space, remove_comments
from loamwork.lineage.parser import NAMES, parsed_dependencies
from loamwork.lineage.queries import (
    _CLEANSED, _EXCLUDED_DB, _K, _LIST, _NAME, _QUOTED, LEVELS, NOW, SERVER, _closure_sql, _cleansed, _database_exclusions, _lowered, _object_exclusions,
)
from loamwork.sources.tables import table

#: Sample definitions with every kind of statement: (object, text).
STATEMENTS = [
    (
        "usp_Load",
        """CREATE PROCEDURE dbo.usp_Load AS
-- select * from dbo.InLineComment
BEGIN /* join dbo.InBlock /* from dbo.InNested */ still out */
  TRUNCATE TABLE stage.Intake;
  INSERT INTO stage.Intake (k) SELECT s.k FROM feed.[Raw] AS s INNER JOIN far.Archive.dbo.Parts p ON p.k = s.k LEFT JOIN Codes c ON c.k = s.k WHERE s.note <> '-- kept' AND s.k > 1;
  UPDATE t SET t.n = 1 FROM core.Stock AS t, core.Bins b WHERE t.k = b.k;
  DELETE FROM core.Expired WHERE k < 0;
  DELETE d FROM core.Doubles d WHERE d.n > 1;
  MERGE core.DimItem AS g USING stage.Intake AS i ON g.k = i.k WHEN NOT MATCHED THEN INSERT (k) VALUES (i.k);
  EXEC dbo.usp_Next ;
  EXECUTE @rc = OtherDB.dbo.usp_Far ;
  SELECT k INTO stage.Copy FROM (SELECT k FROM core.Inner1 ) x ;
  DROP TABLE stage.Gone ;
  ALTER TABLE core.DimItem ADD n int ;
END""",
    ),
    ("v_Union", 'create view dbo.v_Union as select a from t1 union all select a from "odd.name".t2 except select a from t3 x, t4 y where exists ( select 1 from t5 where t5.a = x.a )'),
    ("fn_None", "create function dbo.fn_None ( ) returns int as begin return 1 end"),
    ("fn_Null", None),
]
#: Sample texts with comments: (number, text).
COMMENTS = [
    (1, "select 1 -- one\nfrom t"), (2, "select /* a /* nested */ b */ 2"), (3, "select '-- no comment' from t"), (4, "select [/* name */] from t"), (5, "select 'it''s /* in */' , 1"),
    (6, "select 1 /* open"), (7, "-- all"), (8, 'select "--q" -- end'), (9, None), (10, "a/**/b"),
]


def lineage_statements(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("S", "D", "dbo", n, t) for n, t in STATEMENTS], "servername string, databasename string, schemaname string, objectname string, objectdefinition string")
    return parsed_dependencies(remove_comments(rows))


def lineage_comments(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(COMMENTS, "number int, objectdefinition string")
    return remove_comments(rows).select("number", plain_space("objectdefinition").alias("plain"))


def _dynamic_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each stored merge as source, process and target; its names have three parts."""
    part = lambda c, n: F.split(c, r"\.")[n]
    named = {
        f"{kind}{p}name": part(c, n) for kind, c in (("source", "qualifiedsourcename"), ("target", "qualifiedtargetname")) for n, p in enumerate(("database", "schema", "object"))
    } | {"processdatabasename": F.lit("Merges"), "processschemaname": F.lit("dbo"), "processobjectname": F.col("mergeconfigurationname")}
    server = {f"{kind}servername": F.lit(SERVER) for kind in ("source", "process", "target")}
    types = {"sourceobjecttype": F.lit("U"), "processobjecttype": F.lit("P"), "targetobjecttype": F.lit(None).cast("string")}
    return table(spark, d, "mrg_dynamicmergeconfiguration").select(*(c.alias(n) for n, c in (named | server | types).items()))


def _direct_with_merges(spark: SparkSession, d: str, compat: bool) -> DataFrame:
    return _lowered(direct_dependencies(_cleansed(spark, d), table(spark, d, "lng_objectlist"), _dynamic_merge(spark, d), compat), [*SOURCE, *TARGET]).distinct()


def lineage_direct_merges(spark: SparkSession, d: str) -> DataFrame:
    return _direct_with_merges(spark, d, False)


def lineage_direct_merges_compat(spark: SparkSession, d: str) -> DataFrame:
    return _direct_with_merges(spark, d, True)


def lineage_full_load(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "lng_objectdefinitions").select("objectid", "objectdefinition")
    inventory = table(spark, d, "lng_objectlist").withColumns({c: F.lower(F.trim(c)) for c in OBJECT})
    loaded = full_load(inventory, texts, SERVER, NOW, _database_exclusions(spark), _object_exclusions(spark), max_levels=LEVELS)
    lowered = [c for c in OUT if c not in ("lineagelevel", "lineagedirection", "rootobjecttype", "dependentobjecttype")]
    return loaded.extended.withColumns({c: key(c) for c in lowered}).distinct()


QUERIES = {f.__name__: f for f in (lineage_statements, lineage_comments, lineage_direct_merges, lineage_direct_merges_compat, lineage_full_load)}

_P, _V = ("S", "D", "dbo", "usp_Load"), ("S", "D", "dbo", "v_Union")
_EXPECTED = [
    (*_P, "SELECT", "S", "D", "feed", "Raw"), (*_P, "SELECT", "far", "Archive", "dbo", "Parts"), (*_P, "SELECT", "S", "D", "dbo", "Codes"), (*_P, "SELECT", "S", "D", "core", "Stock"), (*_P, "SELECT", "S", "D", "core", "Bins"),
    (*_P, "SELECT", "S", "D", "core", "Expired"), (*_P, "SELECT", "S", "D", "core", "Doubles"), (*_P, "SELECT", "S", "D", "core", "Inner1"), (*_P, "TRUNCATE", "S", "D", "stage", "Intake"),
    (*_P, "INSERT", "S", "D", "stage", "Intake"), (*_P, "UPDATE", "S", "D", "core", "Stock"), (*_P, "DELETE", "S", "D", "core", "Expired"), (*_P, "DELETE", "S", "D", "core", "Doubles"),
    (*_P, "MERGE", "S", "D", "core", "DimItem"), (*_P, "SELECT", "S", "D", "stage", "Intake"), (*_P, "EXECUTE", "S", "D", "dbo", "usp_Next"), (*_P, "EXECUTE", "S", "OtherDB", "dbo", "usp_Far"),
    (*_P, "INSERT", "S", "D", "stage", "Copy"), (*_P, "DROP", "S", "D", "stage", "Gone"), (*_P, "ALTER", "S", "D", "core", "DimItem"),
    (*_V, "SELECT", "S", "D", "dbo", "t1"), (*_V, "SELECT", "S", "D", "odd.name", "t2"), (*_V, "SELECT", "S", "D", "dbo", "t3"), (*_V, "SELECT", "S", "D", "dbo", "t4"), (*_V, "SELECT", "S", "D", "dbo", "t5"),
]
_UNCOMMENTED = [
    (1, "select 1 from t"), (2, "select 2"), (3, "select '-- no comment' from t"), (4, "select [/* name */] from t"), (5, "select 'it''s /* in */' , 1"), (6, "select 1"), (7, ""), (8, 'select "--q"'), (9, None), (10, "a b"),
]
_TEXT = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
_ROWS = lambda rows: ", ".join(f"({', '.join(map(_TEXT, r))})" for r in rows)

_TYPED = """kinds AS (SELECT {name} AS n, min(trim(objecttype, ' ')) AS k FROM {objects} GROUP BY 1),
direct AS (SELECT DISTINCT {source}, coalesce(a.k, 'UNKNOWN') AS sourcetype, {target}, coalesce(b.k, 'UNKNOWN') AS targettype FROM cleansed LEFT JOIN kinds a ON a.n = {source_name} LEFT JOIN kinds b ON b.n = {target_name})"""
_typed = lambda objects: _TYPED.format(name=_NAME(OBJECT), objects=objects, source=_LIST(SOURCE), target=_LIST(TARGET), source_name=_NAME(SOURCE), target_name=_NAME(TARGET))


def _merges_sql(compat: bool) -> str:
    side = lambda c: f"'{SERVER.lower()}', {_LIST(f'lower(split_part({c}, {chr(39)}.{chr(39)}, {n}))' for n in (1, 2, 3))}"
    process = f"'{SERVER.lower()}', 'merges', 'dbo', lower(mergeconfigurationname), 'P'"
    out = f"""WITH {_CLEANSED}, {_typed('lng_objectlist')}
SELECT * FROM direct UNION SELECT {side('qualifiedsourcename')}, 'U', {process} FROM mrg_dynamicmergeconfiguration"""
    return out if compat else f"{out} UNION SELECT {process}, {side('qualifiedtargetname')}, 'UNKNOWN' FROM mrg_dynamicmergeconfiguration"


_LOADED = f"""listed AS (SELECT * FROM lng_objectlist WHERE {_K('objecttype')} IN ({_QUOTED(t.lower() for t in LISTED)}) AND NOT {_EXCLUDED_DB('servername', 'databasename')}),
able AS (SELECT DISTINCT objectid, {_LIST(f'{_K(c)} AS {c}' for c in OBJECT)}, objecttype FROM listed WHERE {_K('objecttypename')} IN ({_QUOTED(t.lower() for t in DEFINED)})),
texts AS (SELECT able.*, d.objectdefinition FROM able JOIN lng_objectdefinitions d ON d.objectid = able.objectid),
""" + _CLEANSED.replace("FROM lng_objectdefinitions", "FROM texts").replace("FROM lng_objectlist", "FROM listed")
_DOWN, _UP = (_closure_sql(x).replace("FROM edges WHERE", "FROM direct WHERE") for x in (True, False))

SQL = {
    "lineage_statements": f"SELECT * FROM (VALUES {_ROWS(_EXPECTED)}) v({_LIST(NAMES)})",
    "lineage_comments": f"SELECT number, plain FROM (VALUES {_ROWS(_UNCOMMENTED)}) v(number, plain)",
    "lineage_direct_merges": _merges_sql(False),
    "lineage_direct_merges_compat": _merges_sql(True),
    "lineage_full_load": f"WITH RECURSIVE {_LOADED}, {_typed('listed')}, {_DOWN}, {_UP} FROM downstream UNION ALL FROM upstream",
}
