"""The closure queries on a chain of 10 objects."""

import datetime as dt
import random

import pytest

from loamwork.lineage import queries as q
from loamwork.lineage.closure import extended_dependencies
from loamwork.lineage.model import SOURCE, TARGET

LENGTH = 10


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("chain")
    names = [f"t{n:02}" for n in range(LENGTH)]
    rows = [(n, "S", "D", "dbo", a, "U", "S", "D", "dbo", b, "U", dt.datetime(2024, 1, 1)) for n, (a, b) in enumerate(zip(names, names[1:]))]
    schema = ", ".join(["dependencyid long", *(f"{c} string" for c in [*SOURCE, "sourcetype", *TARGET, "targettype"]), "capturedate timestamp"])
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/lng_objectdirectdependency.parquet")
    return str(d)


def expected():
    return sorted((f"t{a:02}", f"t{b:02}", b - a) for a in range(LENGTH) for b in range(a + 1, LENGTH))


def test_all_levels_down_and_up(spark, chain):
    down, up = q.lineage_down(spark, chain).collect(), q.lineage_up(spark, chain).collect()
    assert sorted((r.rootobject, r.dependentobject, r.lineagelevel) for r in down) == expected()
    assert sorted((r.dependentobject, r.rootobject, r.lineagelevel) for r in up) == expected()


def test_no_root_at_the_limit(spark, chain):
    assert q.lineage_limits(spark, chain).count() == 0


def test_impact_of_all_levels(spark, chain):
    assert tuple(q.impact_total(spark, chain).first()) == (LENGTH - 1, LENGTH - 1)


@pytest.mark.parametrize("most", [1, 2, 3, 6, 30])
def test_paths_of_random_graphs(spark, most):
    rng = random.Random(most)
    pairs = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(13)})
    rows = [("S", "D", "dbo", a, "U", "S", "D", "dbo", b, "U") for a, b in pairs]
    edges = spark.createDataFrame(rows + rows[:2], ", ".join(f"{c} string" for c in [*SOURCE, "sourcetype", *TARGET, "targettype"]))
    paths, level = [], [list(p) for p in pairs]
    while level:
        paths += level
        level = [[*p, b] for p in level for a, b in pairs if a == p[-1] and b not in p and len(p) <= most]
    want = sorted(" -> ".join(f"S.D.dbo.{n}" for n in p) for p in paths)
    for directions, arrow in ((("Downstream",), " -> "), (("Upstream",), " <- ")):
        found = extended_dependencies(edges, max_levels=most, directions=directions).collect()
        assert all(r.lineagelevel == r.lineagepath.count(arrow) for r in found)
        if arrow == " -> ":
            assert sorted(r.lineagepath for r in found) == want
        elif all(a != b for a, b in pairs):  # a loop can only begin a path, so up and down differ where there are some
            assert len(found) == len(want)
