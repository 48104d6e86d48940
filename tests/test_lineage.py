import datetime as dt

import pytest

from loamwork.lineage import exclusions as x
from loamwork.lineage.batch import full_load
from loamwork.lineage.closure import depth_limits, extended_dependencies
from loamwork.lineage.edges import cleanse, direct_dependencies
from loamwork.lineage.model import SOURCE, TARGET
from loamwork.lineage.normalize import without_comments
from loamwork.lineage.parser import parsed_dependencies, references
from loamwork.lineage.reports import circular, cross_database, impact_summary, object_summary, orphaned, parsed_versus_expression

NOW = dt.datetime(2024, 1, 1)
EDGES = ", ".join(f"{c} string" for c in [*SOURCE, "sourcetype", *TARGET, "targettype"])
OBJECTS = "objectid long, servername string, databasename string, schemaname string, objectname string, objecttype string, objecttypename string"


def edges(spark, pairs):
    return spark.createDataFrame([("S", "D", "dbo", a, "U", "S", "D", "dbo", b, "U") for a, b in pairs], EDGES)


def objects(spark, names):
    return spark.createDataFrame([(n, "S", "D", s, o, t, tn) for n, (s, o, t, tn) in enumerate(names)], OBJECTS)


def test_comments():
    assert without_comments("a -- x\nb /* c /* d */ e */ f '--no' [--n] \"/*\" 'x''--' -- end") == "a \nb   f '--no' [--n] \"/*\" 'x''--' "
    assert without_comments("a /* open") == "a  "
    assert without_comments(None) is None


@pytest.mark.parametrize(
    ("text", "found", "compat"),
    [
        ("p select 1 from a join b on 1", "a b", "a"),
        ("p select 1 from a x inner join b on 1", "a b", "a b"),
        ("p select 1 from a as x , b where 1", "a b", "a"),
        ("p select 1 from a , b y , c where 1", "a b c", "a b c"),
        ("p select 1 from (select 2 from q ) z , w", "q w", "q"),
        ("p delete from t where 1", "DELETE t", "DELETE t"),
        ("p delete y from dbo.t y where 1", "DELETE dbo.t", "DELETE dbo.t"),
        ("p update u set a = 1 from s.t u where 1", "UPDATE s.t", "UPDATE s.t"),
        ("p insert into t (a ) values (1 )", "INSERT t", "INSERT t"),
        ("p insert t values (1 )", "", ""),
        ("p select a into n from m", "INSERT n", "INSERT n"),
        ("p merge into t as x using s on 1", "MERGE t", "MERGE t"),
        ("p exec (@sql ) ; execute dbo.q ; end", "EXECUTE dbo.q", "EXECUTE dbo.q"),
        ("p create table a (b int ) ; create table c (d int )", "CREATE a CREATE c", "CREATE a"),
        ("create procedure p as truncate table t ; end", "TRUNCATE t", "TRUNCATE t"),
    ],
)
def test_parser(text, found, compat):
    for mode, want in ((False, found), (True, compat)):
        got = references(text, mode)
        names = want.split()
        pairs = list(zip(names[::2], names[1::2], strict=True)) if names and names[0].isupper() else [("SELECT", n) for n in names]
        only = {op for op, _ in pairs}
        assert sorted(g for g in got if g[0] in only) == sorted(pairs)
        if not want:
            assert not got


def test_defaults_of_missing_name_parts(spark, rows):
    df = spark.createDataFrame([("S", "D", "s1", "p", "create proc p as select 1 from [a b], x.[y] , D2..t , E.D3.s.u z , a.b.c.d.e"), ("S", "D", "s", "n", None)], "servername string, databasename string, schemaname string, objectname string, objectdefinition string")
    found = {r[-4:] for r in rows(parsed_dependencies(df))}
    assert ("S", "D", "x", "y") in found and ("S", "D2", "dbo", "t") in found and ("E", "D3", "s", "u") in found
    assert rows(parsed_dependencies(df.limit(0))) == []


def test_cleanse_turns_and_keeps_remote_names(spark, rows):
    known = objects(spark, [("dbo", "A", "U", "USER_TABLE"), ("dbo", "P", "P", "X")])
    parsed = spark.createDataFrame(
        [("S", "D", "dbo", "P", "SELECT", "S", "D", "dbo", "a "), ("S", "D", "dbo", "p", "select", "s", "d", "DBO", "A"), ("S", "D", "dbo", "P", "SELECT", "S", "D", "dbo", "#tmp"), ("S", "D", "dbo", "P", "INSERT", "R", "D", "dbo", "far")],
        ", ".join(f"{c} string" for c in [*SOURCE, "operationtype", *TARGET]),
    )
    clean = cleanse(parsed, known, "s")
    assert sorted((r.sourceobject.strip().lower(), r.targetobject.strip().lower()) for r in clean.collect()) == [("a", "p"), ("p", "far")]
    direct = direct_dependencies(clean, known)
    assert {(r.sourcetype, r.targettype) for r in direct.collect()} == {("U", "P"), ("P", "UNKNOWN")}
    parts = [f"{k}{p}" for k in ("source", "process", "target") for p in ("servername", "databasename", "schemaname", "objectname", "objecttype")]
    merge = spark.createDataFrame([tuple(["S", "D", "dbo", n, None][i] for n in "xyz" for i in range(5))], ", ".join(f"{c} string" for c in parts))
    assert direct_dependencies(clean, known, merge).count() == 4
    assert direct_dependencies(clean, known, merge, compat=True).count() == 3


def test_closure_with_a_cycle_and_an_exclusion(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d1")])
    out = x.add(x.empty(spark, x.OBJECTS), NOW, "t", objectname="d%")
    found = extended_dependencies(e, out, directions=("Downstream",))
    assert sorted((r.rootobject, r.dependentobject, r.lineagelevel) for r in found.collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "a", 2), ("b", "c", 1), ("c", "a", 1), ("c", "b", 2)]
    up = extended_dependencies(e, None, directions=("Upstream",)).where("rootobject = 'd1'")
    assert sorted(r.lineagepath for r in up.collect()) == ["S.D.dbo.d1 <- S.D.dbo.c", "S.D.dbo.d1 <- S.D.dbo.c <- S.D.dbo.b", "S.D.dbo.d1 <- S.D.dbo.c <- S.D.dbo.b <- S.D.dbo.a"]
    assert {r.rootobject for r in depth_limits(extended_dependencies(e, None, 2), 2).collect()} == {"a", "b", "c", "d1"}


def test_a_name_within_a_name_is_no_cycle(spark):
    e = edges(spark, [("Order", "OrderLine"), ("OrderLine", "Order2"), ("OrderLine", "Ord")])
    down = lambda compat: {(r.rootobject, r.dependentobject) for r in extended_dependencies(e, None, directions=("Downstream",), compat=compat).collect()}
    assert ("Order", "Ord") in down(False) and ("Order", "Ord") not in down(True)


def test_reports(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("s", "s"), ("a", "c")])
    assert sorted(r.sourceobject for r in circular(e).collect()) == ["a", "b", "s"]
    assert cross_database(e).count() == 0
    known = objects(spark, [("dbo", "A ", "U", "X"), ("dbo", "z", "U", "X"), ("dbo", None, "U", "X")])
    assert [r.objectname for r in orphaned(known, e).orderBy("objectname").collect()] == [None, "z"]
    assert {r.objectname: (r.dependsoncount, r.dependedbycount) for r in object_summary(known, e).collect()} == {"A ": (2, 1), "z": (0, 0), None: (0, 0)}
    assert tuple(impact_summary(extended_dependencies(e), ("s", "d", "DBO", "b")).first()) == (2, 2)


def test_parsed_versus_expression(spark):
    parsed = spark.createDataFrame([("S", "D", "dbo", p, "SELECT", "S", "D", "dbo", t) for p, t in (("p", "a"), ("p", "b"), ("ckx", "a"), ("a", "a"))], ", ".join(f"{c} string" for c in [*SOURCE, "operationtype", *TARGET]))
    columns = ["referencingserver", "referencingdatabase", "referencingschema", "referencingobject", "referenced_server_name", "referenced_database_name", "referenced_schema_name", "referenced_entity_name"]
    expression = spark.createDataFrame([("S", "D", "dbo", "P", "S", "D", "dbo", "A"), ("S", "D", "dbo", "q", "S", "D", "dbo", "b"), ("S", "D", "dbo", "q", "S", "D", "dbo", "none")], ", ".join(f"{c} string" for c in columns))
    found = parsed_versus_expression(parsed, expression, objects(spark, [("dbo", "a", "U", "X"), ("dbo", "b", "U", "X")]))
    assert sorted((r[0], r.sourceobject, r.targetobject) for r in found.collect()) == [("ExpressionOnly", "q", "b"), ("ParsedOnly", "p", "b")]


def test_exclusions(spark):
    d = x.add_defaults(x.add(x.empty(spark, x.DATABASES), NOW, "me", servername="S", databasename="Tmp[_]%"), NOW, "me")
    assert d.count() == 5 and x.add_defaults(d, NOW, "me").count() == 5
    with pytest.raises(ValueError):
        x.add(d, NOW, "me", servername="s", databasename="tmp[_]%")
    assert x.remove(d, databasename="tmp[_]%").count() == 5
    assert x.remove(d, servername="S", databasename="tmp[_]%").count() == 4
    assert x.remove(d, 1).count() == 4
    df = spark.createDataFrame([("S", "tmp_1"), ("S", "tmpx1"), ("R", "tmp_1"), ("R", "MASTER"), (None, "tmp_2")], "s string, d string")
    assert sorted(tuple(r) for r in x.database_excluded(df.na.fill("?"), "s", "d", d).collect()) == [("?", "tmp_2"), ("R", "tmp_1"), ("S", "tmpx1")]


def test_full_load(spark):
    inventory = objects(spark, [("dbo", "t1", "U", "USER_TABLE"), ("dbo", "v1", "V", "VIEW"), ("dbo", "p1", "P", "SQL_STORED_PROCEDURE"), ("dbo", "t2", "U", "USER_TABLE"), ("dbo", "k", "PK", "KEY")])
    texts = spark.createDataFrame([(1, "create view v1 as select * from t1 -- from t2"), (2, "create procedure p1 as /* from x */ insert into dbo.t2 select * from v1 ; end")], "objectid long, objectdefinition string")
    load = full_load(inventory, texts, "S", NOW, x.empty(spark, x.DATABASES))
    assert sorted((r.sourceobject, r.targetobject) for r in load.direct.collect()) == [("p1", "t2"), ("t1", "v1"), ("v1", "p1")]
    assert load.extended.where("lineagedirection = 'Downstream' and rootobject = 't1'").count() == 3
    assert load.objects.count() == 4 and load.limits.count() == 0
