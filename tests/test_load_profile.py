import datetime as dt

import pytest

from loamwork.operators.load_profile import CUSTOMER_LOADS as P
from loamwork.operators.load_profile import LoadProfile, ProfileStore

SCHEMA = "sourcerowid long, feedcode string, snapshotno int, snapshotdate date, deliveredat timestamp, customerid int, dateofbirth date, firstname string, lastname string, email string, country string, age int, loyaltypoints int, columnname string"
REPORT = "profileid long, feedcode string, snapshotno int, columnname string, nullvalues long, distinctvalues long, maxlengthreached int"
D = dt.date(2024, 5, 1)


def row(n, snap=1, **over):
    base = dict(customerid=n, dateofbirth=dt.date(1980, 1, 1), firstname=f"N{'abcdefghijklmnop'[n % 16]}", lastname="Lee", email=f"u{n}@a.example", country="Norland", age=40, loyaltypoints=n)
    base |= over
    return (n, "f", snap, D, None, *base.values(), "clash")


def run(spark, data, report=()):
    store = ProfileStore(spark, P)
    store.add(spark.createDataFrame(data, SCHEMA))
    found = store.findings(spark.createDataFrame(list(report), REPORT))
    return sorted(tuple(r)[1:] for r in found.collect())


def test_patterns_ranges_and_lengths(spark):
    assert run(spark, [row(n) for n in range(4)]) == []
    assert run(spark, [row(1, email=" u@a.example ")]) == []
    bad = {
        ("email", "pattern"): dict(email="a at b.example"), ("firstname", "pattern"): dict(firstname="A7"), ("lastname", "pattern"): dict(lastname="L\x07e"), ("country", "pattern"): dict(country="1"),
        ("age", "range"): dict(age=121), ("loyaltypoints", "range"): dict(loyaltypoints=-1), ("dateofbirth", "range"): dict(dateofbirth=dt.date(2024, 5, 2)),
        ("email", "maxlength"): dict(email="a" * 245 + "@b.example"), ("firstname", "maxlength"): dict(firstname="a" * 100 + "  "),
    }
    for (column, finding), over in bad.items():
        assert run(spark, [row(1, **over)]) == [(1, column, finding)]
    assert run(spark, [row(1, firstname="a" * 99 + "  ", age=None, email=None, dateofbirth=None)]) == []


def test_drift_against_the_previous_delivered_load(spark):
    first = [row(n) for n in range(10)]
    later = [row(n, 3, country=None if n < 2 else "Norland", lastname="Lee" if n < 8 else "Moe", customerid=n % 4, loyaltypoints=n % 5) for n in range(10)]
    assert run(spark, first + later) == [(3, "country", "mode"), (3, "country", "nulls"), (3, "customerid", "distinct"), (3, "customerid", "mode"), (3, "lastname", "distinct"), (3, "lastname", "mode")]


def test_stored_profile(spark):
    data = [row(1, firstname=None), row(2, firstname="b" * 100), row(3, firstname=" B" + "b" * 98 + "b ")]
    good, wrong = (1, "f", 1, "firstname", 1, 1, 1), (2, "f", 1, "age", 0, 2, None)
    gone = (3, "f", 9, "age", 0, 2, None)
    found = [x for x in run(spark, data, [good, wrong, wrong, gone]) if x[2] == "misreported"]
    assert found == [(1, "age", "misreported")]


def test_states_of_slices_add_up(spark, rows):
    data = spark.createDataFrame([row(n, 1 + n % 2, country=None if n % 3 else "X") for n in range(30)], SCHEMA)
    whole, a, b = P.state(data), P.state(data.where("sourcerowid < 11")), P.state(data.where("sourcerowid >= 11"))
    assert rows(P.merge(a, b).select(*whole.columns)) == rows(whole)


def test_loads_are_added_one_after_another_and_in_pieces(spark, rows, tmp_path):
    data = [row(n, 1 + n % 4, country=None if n % 3 else "X1", age=130 if n == 7 else 40, loyaltypoints=n % 5) for n in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    report = spark.createDataFrame([(1, "f", 1, "age", 0, 9, None)], REPORT)
    whole = ProfileStore(spark, P)
    whole.add(df)
    path = f"file://{tmp_path}/profile"
    slices = ["snapshotno = 1", "snapshotno = 2 and sourcerowid < 30", "snapshotno in (3, 4)", "snapshotno = 2 and sourcerowid >= 30", "snapshotno = 9"]
    for n, where in enumerate(slices):
        store = ProfileStore(spark, P, path)
        for _ in range(2):  # delivered twice
            store.add(df.where(where), f"b{n}")
        store.close()
    kept = ProfileStore(spark, P, path)
    assert len(kept.store.of("state")) == 5
    same = lambda a, b: rows(a.select(*b.columns)) == rows(b)
    assert same(kept.state(), whole.state()) and same(kept.metrics(), whole.metrics()) and whole.metrics().count() == 32
    assert rows(kept.findings(report)) == rows(whole.findings(report)) and rows(kept.control_limits(2)) == rows(whole.control_limits(2))
    with pytest.raises(ValueError):
        ProfileStore(spark, LoadProfile("feedcode", "snapshotno", ["age"]), path)


def test_whole_profile_has_ranges_lengths_violations_and_the_mode(spark):
    data = [row(1, age=9, loyaltypoints=-5, country="A1"), row(2, age=10, loyaltypoints=100, firstname="  " + "b" * 98 + " "), row(3, age=10, loyaltypoints=20, country=None, email=None), row(4, 2, age=None)]
    found = {(r.snapshotno, r.columnname): tuple(r)[3:] for r in P.profile(spark.createDataFrame(data, SCHEMA)).collect()}
    assert len(found) == 16
    assert found[1, "age"] == (3, 0, 2, "10", 2, "9", "10", None, None, None, 0)
    assert found[1, "loyaltypoints"] == (3, 0, 3, "20", 1, "-5", "100", None, None, None, 1)
    assert found[1, "firstname"] == (3, 0, 3, "nd", 1, "b" * 98, "nd", 100, 1, 0, None)
    assert found[1, "country"] == (3, 1, 2, "norland", 1, "a1", "norland", 7, 0, 1, None)
    assert found[2, "age"] == (1, 1, 0, None, 0, None, None, None, None, None, 0)
    assert found[1, "dateofbirth"] == (3, 0, 1, "1980-01-01", 3, "1980-01-01", "1980-01-01", None, None, None, 0)


def test_control_limits_and_empty_table(spark):
    loads = [row(100 * s + n, s, age=40 + (n % 2), country=None if s == 6 else "Norland") for s in range(1, 7) for n in range(4)]
    metrics = P.metrics(P.state(spark.createDataFrame(loads, SCHEMA)))
    found = {(r.snapshotno, r.columnname, r.metric) for r in P.control_limits(metrics).collect()}
    assert (6, "country", "null_share") in found and not any(c == "age" for _, c, _ in found)
    assert run(spark, []) == []
