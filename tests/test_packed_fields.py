import random

import pytest

from loamwork.operators.packed_fields import Segmenter, split_fields

CASES = {
    "a,b;c|d": ["a", "b", "c", "d"],
    "  a \n\t b ": ["a", "b"],
    "[a,b] , [c]]d]": ["a,b", "c]d"],
    "\"x \"\"y\"\"\", 'it''s' `p``q`": ['x "y"', "it's", "p`q"],
    "(a & b) / c": ["a", "b", "c"],
    "Señal_2，#tmp $x @y": ["Señal_2", "#tmp", "$x", "@y"],
    "a,,a": ["a", "a"],
    "": [],
    " , ;": [],
    "[]": [],
    "\"\" x \"a b\" '' y": ["x", "a b", "y"],
    "['a] 'b]'": ["'a", "b]"],
}


@pytest.mark.parametrize("text", CASES)
def test_grammar(text):
    assert Segmenter([]).split(text) == CASES[text]


def test_null_and_very_long_text():
    assert Segmenter([]).split(None) == []
    assert Segmenter([]).split("[a b];" * 20_000) == ["a b"] * 20_000


def test_known_values_decide_where_marks_are_missing():
    s = Segmenter(["Client Rate", "Sale's Date"])
    assert s.split("[Client Rate; Foo") == ["Client Rate", "Foo"]
    assert Segmenter([]).split("[Client Rate; Foo") == ["Client", "Rate", "Foo"]
    assert s.split("Client Rate, x") == ["Client", "Rate", "x"]
    assert s.split("x; Client Rate], y") == ["x", "Client Rate", "y"]
    assert s.split("Vendor's, 'Order'") == ["Vendor", "s", "Order"]


def test_known_values_count_beside_letters_whose_lower_form_is_longer(spark, rows):
    assert Segmenter(["Client Rate"]).split("[client rate; İd") == ["client rate", "İd"]
    assert Segmenter(["İş Kodu"]).split("x; İŞ kodu]") == ["x", "İŞ kodu"]
    df = spark.createDataFrame([(1, "[İş Kodu]"), (2, "[İş Kodu; y")], "id int, m string")
    assert rows(split_fields(df, "id", ["m"])) == [(1, "m", 1, "İş Kodu"), (2, "m", 1, "İş Kodu"), (2, "m", 2, "y")]


def test_round_trip_of_random_names():
    rng = random.Random(1)
    plain, odd = "abZ09_$#@é", "ab ,;|[]\"'`./\n"
    for _ in range(1500):
        names, text = [], ""
        for n in range(rng.randrange(6)):
            if rng.random() < 0.5:
                name = "".join(rng.choice(plain) for _ in range(rng.randrange(1, 6)))
                written = name
            else:
                name = "".join(rng.choice(odd) for _ in range(rng.randrange(1, 6)))
                a, b = rng.choice(["[]", '""', "''", "``"])
                written = a + name.replace(b, b * 2) + b
            names.append(name)
            text += (rng.choice([",", " ; ", "\t", " | ", "，", "\r\n"]) if n else "") + written
        for known in ([], ["a b", "x,y", " ", ",", "a,", "'", "]", "b[", "a'", '"', "a b;"]):
            assert Segmenter(known).split(text) == names, text


def test_rows_with_positions(spark, rows):
    df = spark.createDataFrame([(1, "a,[b c]", None), (2, "", "x;x"), (3, None, None)], "id int, m string, i string").selectExpr("*", "'z' as fieldname", "1 as valueposition")
    assert rows(split_fields(df, "id", ["m", "i"])) == [(1, "m", 1, "a"), (1, "m", 2, "b c"), (2, "i", 1, "x"), (2, "i", 2, "x")]
    assert rows(split_fields(df.limit(0), "id", ["m", "i"])) == []


def test_blocks_of_the_dictionary_change_nothing(spark, rows):
    texts = ["[Client Rate];'Sale Date'", "`Other, One` | x", "[Client Rate; Foo", "x; Other, One`", "['a b'", "\"Sale Date"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, m string")
    one, many = (rows(split_fields(df, "id", ["m"], n)) for n in (200_000, 1))
    assert one == many and (2, "m", 1, "Client Rate") in one and (3, "m", 2, "Other, One") in one and (5, "m", 1, "Sale Date") in one
