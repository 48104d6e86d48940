import datetime as dt

from loamwork.operators.orphans import object_orphans

OBJECTS = "objectid long, servername string, databasename string, schemaname string, objectname string, createdate timestamp, dropdate timestamp, capturedate timestamp"
REFS = (
    "expressiondependencyid long, referencingobjectid int, referencingserver string, referencingdatabase string, referencingschema string, referencingobject string, "
    "referenced_id int, referenced_server_name string, referenced_database_name string, referenced_schema_name string, referenced_entity_name string, referencedobjecttype string, capturedate timestamp"
)
DAY = [dt.datetime(2024, 1, n) for n in range(1, 30)]


def obj(i, name, begins, ends=None):
    return (i, "S", "D", "dbo", name, begins, ends, None)


def ref(n, owner, target_id=None, name=None, at=DAY[9]):
    return (n, owner, "S", "D", "dbo", f"o{owner}", target_id, "s ", "D", "DBO", name, "U", at)


def run(spark, objects, refs):
    found = object_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(objects, OBJECTS))
    return sorted((tuple(r) for r in found.select("expressiondependencyid", "orphan_kind", "hop").collect()), key=repr)


def test_missing_dropped_and_later_objects(spark):
    objects = [obj(1, "o1", None), obj(2, "o2", DAY[0], DAY[9]), obj(3, "o3", DAY[10]), obj(4, "back", DAY[0], DAY[5]), obj(5, "BACK ", DAY[8])] * 2
    refs = [
        ref(1, 90, 1), ref(2, 91, 2), ref(3, 92, 3), ref(4, 93, 77), ref(5, 94, None, " Back"), ref(6, 94, None, "back", DAY[6]), ref(7, 94, None, "none"),
        ref(8, 94, 77, "back"), ref(9, 94, 2, None, None), ref(10, 94, None, None), ref(11, 94, 2, None, DAY[0]), ref(11, 94, 2, None, DAY[0]), ref(12, 94, 2, None, DAY[8]),
    ]
    direct = sorted(n for n, kind, _ in run(spark, objects, refs) if kind == "direct")
    assert direct == [2, 3, 4, 6, 7, 8, 10]


def test_inherited_orphans_down_the_keys_and_around_a_cycle(spark):
    objects = [obj(n, f"o{n}", None) for n in range(1, 8)]
    # 1 refers to nothing; 2 refers to 1; 3 refers to 2 by name; 4 and 5 refer to each other and 4 to 3; 6 is clean
    refs = [ref(1, 1, 99), ref(2, 2, 1), ref(3, 3, None, "O2"), ref(4, 4, 3), ref(5, 5, 4), ref(6, 4, 5), ref(7, 6, 7)]
    assert run(spark, objects, refs) == [(1, "direct", 0), (2, "inherited", 1), (3, "inherited", 2), (4, "inherited", 3), (5, "inherited", 4), (6, "inherited", 5)]


def test_rows_without_an_id_and_repeated_rows_each_count(spark):
    objects = [obj(1, "o1", None), obj(2, "o2", None)]
    refs = [ref(None, 1, 99), ref(None, 1, 99), ref(5, 2, 1), ref(5, 2, 1), ref(None, 7, 2)]
    assert run(spark, objects, refs) == sorted([(None, "direct", 0)] * 2 + [(5, "inherited", 1)] * 2 + [(None, "inherited", 2)], key=repr)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [ref(1, 1, 1)]) == [(1, "direct", 0)]
    assert run(spark, [obj(1, "a", None)], []) == []
