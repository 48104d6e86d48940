import datetime as dt
import random

from loamwork.operators.snapshots import snapshot_changes

SCHEMA = "rowid long, feed string, n int, at timestamp, k int, name string, points int, g string"
T = [dt.datetime(2024, 1, 1, 0, m) for m in range(60)]


def run(spark, data):
    found = snapshot_changes(spark.createDataFrame(data, SCHEMA), "feed", "n", "k", "at", "rowid", ["name", "points"])
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_added_removed_changed_with_gaps(spark):
    data = [
        (1, "f", 1, T[0], 1, "Ann ", 5, "x"), (2, "f", 1, T[0], 2, "Bo", None, "x"), (3, "f", 1, T[0], 3, "Cy", 1, "x"),
        (4, "f", 4, T[1], 1, " ANN", 5, "y"), (5, "f", 4, T[1], 3, "Cy", None, "x"),
        (6, "f", 7, T[2], 1, "Ann", 5, "x"), (7, "f", 7, T[2], 2, "Bo", None, "x"), (8, "f", 7, T[2], 3, "Cy", None, "x"),
    ]
    assert run(spark, data) == [("f", 4, 2, "removed"), ("f", 4, 3, "changed"), ("f", 7, 2, "added")]


def test_latest_delivery_counts_and_null_is_a_value(spark):
    data = [
        (1, "f", 1, T[5], 1, "a", 1, "x"), (2, "f", 1, T[9], 1, "b", 1, "x"), (3, "f", 1, None, 1, "c", 1, "x"),
        (4, "f", 2, T[6], 1, "b", 1, "x"), (5, "f", 2, T[6], 1, "b", 1, "x"), (6, "f", 2, T[6], None, None, None, None),
        (7, "f", 3, T[7], 1, None, 1, "x"), (8, "f", 3, T[7], None, "", None, None), (9, None, 1, T[7], 1, "q", 1, "x"), (10, None, 2, T[7], 2, "q", 1, "x"),
    ]
    assert run(spark, data) == sorted([("f", 2, None, "added"), ("f", 3, 1, "changed"), ("f", 3, None, "changed"), (None, 2, 1, "removed"), (None, 2, 2, "added")], key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    data = [(i, f"f{rng.randrange(3)}", rng.randrange(5), T[rng.randrange(50)], rng.randrange(8), rng.choice(["a", "b", None]), rng.choice([1, None]), "") for i in range(160)]
    state: dict = {}
    for i, f, n, at, k, name, points, _ in sorted(data, key=lambda r: (r[3], r[0])):
        state.setdefault(f, {}).setdefault(n, {})[k] = (name, points)
    want = []
    for f, snaps in state.items():
        order = sorted(snaps)
        for a, b in zip(order, order[1:], strict=False):
            x, y = snaps[a], snaps[b]
            want += [(f, b, k, "removed") for k in x.keys() - y.keys()] + [(f, b, k, "added") for k in y.keys() - x.keys()] + [(f, b, k, "changed") for k in x.keys() & y.keys() if x[k] != y[k]]
    assert run(spark, data) == sorted(want, key=repr)


def test_one_snapshot_or_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "f", 1, T[0], 1, "a", 1, "")]) == []
