import pytest
from pyspark.sql import functions as F

from loamwork.functions.names import full_key, like_regex, name_part, quoted, split_name


@pytest.mark.parametrize(("name", "parts"), [("a", ["a"]), ("a.b", ["a", "b"]), ("[a.b].\"c\"", ["a.b", "c"]), ("d..t", ["d", None, "t"]), ("a.b.c.d.e", None), ("[x]]y]", ["x]y"]), ("[x", None), (None, None)])
def test_split(name, parts):
    assert split_name(name) == parts


def test_part():
    assert (name_part("s.d.b.o", 1), name_part("s.d.b.o", 4), name_part("o", 2)) == ("o", "s", None)
    assert split_name(f"{quoted('a.b]')}.{quoted('c')}") == ["a.b]", "c"]


def test_keys_and_patterns(spark):
    df = spark.createDataFrame([(" A ", "b", "C", "é")], "a string, b string, c string, d string")
    assert df.select(full_key("a", "b", "c", "d")).first()[0] == "a.b.c.é"
    cases = [("a%c", "abbc", True), ("a_c", "abc", True), ("a_c", "abbc", False), ("a[_]c", "abc", False), ("a[_]c", "a_c", True), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("a.c", "abc", False), ("A\\b", "a\\b", True), ("a[c", "a[c", True)]
    df = spark.createDataFrame(cases, "p string, s string, want boolean")
    assert df.where(F.regexp_like("s", like_regex("p")) != F.col("want")).count() == 0
