import collections
import random

from loamwork.operators import hierarchy as h



def descendants(df):
    return h.descendants(df, df.parent, df.child)


def hierarchy(df):
    return h.hierarchy(df, df.parent, df.child)


SCHEMA = "parent string, child string, name string"


def links(spark, pairs):
    return spark.createDataFrame([(a, b, "x") for a, b in pairs], SCHEMA)


def reached(pairs):
    down = collections.defaultdict(set)
    for a, b in pairs:
        if a is not None and b is not None:
            down[a].add(b)
    out = set()
    for a in list(down):
        stack = list(down[a])
        while stack:
            b = stack.pop()
            if (a, b) not in out:
                out.add((a, b))
                stack += down.get(b, ())
    return sorted(out)


def test_descendants_of_random_graphs(spark, rows):
    rng = random.Random(5)
    for edges in (12, 25):
        pairs = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(edges)]
        assert rows(descendants(links(spark, pairs + pairs[:3]))) == reached(pairs)


def test_deep_chain_and_cycle_at_its_end(spark, rows):
    pairs = [(f"{i:02d}", f"{i + 1:02d}") for i in range(14)] + [("14", "12")]
    assert rows(descendants(links(spark, pairs))) == reached(pairs)


def test_nulls_self_links_and_empty_table(spark, rows):
    assert rows(descendants(links(spark, [(None, "a"), ("a", None), ("s", "s")]))) == [("s", "s")]
    assert rows(descendants(links(spark, []))) == []
    assert rows(hierarchy(links(spark, []))) == []


def test_hierarchy_of_tree_diamond_and_cycles(spark, rows):
    pairs = [("r", "a"), ("r", "b"), ("a", "d"), ("b", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("y", "z"), ("e", "d")]
    found = {r[0]: r[1:] for r in rows(hierarchy(links(spark, pairs)))}
    assert found["r"] == ("r", 0, "r", 4, 0)
    assert found["d"] == ("r", 2, "r -> a -> d", 2, 1)
    assert found["e"] == ("r", 3, "r -> a -> d -> e", 2, 1)
    assert found["x"] == ("x", 0, "x", 3, 1)
    assert found["z"] == ("x", 2, "x -> y -> z", 0, 0)
    assert len(found) == 8
