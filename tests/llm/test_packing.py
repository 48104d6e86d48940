import random

import pytest

from loamwork.llm.packing import Bins, check, crossover, evolve, exact, fill, individual, lower_bound, pack

SCHEMA = "doc_id long, text string, bin string, tokens string, container_id string"


def valid(bins: Bins):
    placed = sorted(i for b in bins.items for i in b)
    assert placed == list(range(len(bins.sizes)))
    assert all(sum(bins.sizes[i] for i in b) + r == bins.capacity and r >= 0 for b, r in zip(bins.items, bins.room, strict=True))


def test_crossover_keeps_every_item_once():
    rng = random.Random(1)
    sizes = [rng.randrange(0, 100) for _ in range(400)]
    a, b = individual(sizes, 100, rng), individual(sizes, 100, None)
    valid(a), valid(b)
    for _ in range(5):
        a, b = crossover(a, b, rng), crossover(b, a, rng)
        valid(a), valid(b)


def test_other_individuals_and_the_lower_bound():
    rng = random.Random(4)
    for _ in range(40):
        capacity = rng.randrange(2, 60)
        sizes = [rng.randrange(0, capacity + 1) for _ in range(rng.randrange(1, 9))]
        made = exact(sizes, capacity)
        valid(made)

        def best(rest, room):  # all packings
            if not rest:
                return len(room)
            found = len(sizes)
            for k in {r: k for k, r in enumerate(room) if r >= rest[0]}.values():
                found = min(found, best(rest[1:], [*room[:k], room[k] - rest[0], *room[k + 1 :]]))
            return min(found, best(rest[1:], [*room, capacity - rest[0]])) if len(room) < len(sizes) else found

        least = best(sorted(sizes, reverse=True), [])
        halves = [lower_bound(sizes, capacity), least, len(made.items)]
        assert halves == sorted(halves) or not sum(sizes)


def test_evolution_beats_best_fit():
    rng = random.Random(11)
    gained = 0
    for n in range(6):
        sizes = [rng.randrange(26, 51) for _ in range(240)]
        first = len(individual(sizes, 100, None).items)
        _, (bins, _) = evolve(sizes, 100, [], str(n), 8, 30, 15)
        assert lower_bound(sizes, 100) <= bins <= first
        gained += first - bins
    assert gained > 0


def test_evolution_gets_no_worse_and_near_the_bound():
    rng = random.Random(2)
    sizes = [rng.randrange(20, 70) for _ in range(300)]
    first = len(individual(sizes, 100, None).items)
    best, (bins, _) = evolve(sizes, 100, [], "7", 8, 6)
    again, (bins2, _) = evolve(sizes, 100, [best, best], "8", 8, 6)
    assert len(set(best)) == bins <= first and bins2 <= bins and len(again) == 300
    assert evolve([], 100, [], "1", 4, 2) == ([], (0, 0))


@pytest.fixture(scope="module")
def packed(spark):
    rng = random.Random(3)
    texts = [(n, " ".join(rng.choice(["alpha", "of", "tree", "x1"]) for _ in range(rng.randrange(0, 90)))) for n in range(120)] + [(200, None), (201, ""), (7, "again and again"), (300, "word " * 4000)]
    df = spark.createDataFrame([(*t, None, None, None) for t in texts], SCHEMA)
    kinds = spark.createDataFrame([(1, 64), (2, 300), (2, 300), (3, None)], "container_id long, capacity_tokens int")
    return texts, pack(df, kinds, block_items=50).cache()


def test_every_token_has_one_place(packed):
    import base64

    import tiktoken

    from loamwork.llm.packing import PATTERN, TOKENIZER

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    encode = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts, df = packed
    rows = [r.asDict() for r in df.collect()]
    for container, capacity in ((1, 64), (2, 300)):
        own = [r for r in rows if r["container_id"] == container]
        for doc in {d for d, _ in texts} - {7}:
            t = next(x for d, x in texts if d == doc)
            size = len(encode(t or ""))
            pieces = sorted((r["token_start"], r["tokens"]) for r in own if r["doc_id"] == doc)
            assert sum(n for _, n in pieces) == size
            assert len(pieces) == max(1, -(-size // capacity))
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and pieces[0][0] == 0
        assert sum(r["doc_id"] == 7 and r["token_start"] == 0 for r in own) == 2
        bins: dict = {}
        for r in own:
            bins.setdefault(r["bin"], []).append(r)
        for b in bins.values():
            at = 0
            for n, r in enumerate(sorted(b, key=lambda r: r["place"]), 1):
                assert (r["place"], r["bin_start"]) == (n, at)
                at += r["tokens"]
            assert at <= capacity


def test_check_finds_faults(spark, packed):
    texts, df = packed
    docs = spark.createDataFrame([(*t, None, None, None) for t in texts], SCHEMA)
    figures = lambda p: {r.container_id: tuple(r)[2:] for r in check(p, docs).collect()}
    assert figures(df) == {1: (len(texts), 0, 0, 0, 0), 2: (len(texts), 0, 0, 0, 0)}
    assert figures(df.where("doc_id is null or doc_id <> 3 or container_id <> 1"))[1][0] == len(texts) - 1
    assert figures(df.where("doc_id <> 300 or piece <> 1"))[1][1] > 0
    assert figures(df.union(df.where("container_id = 2 and tokens > 150")))[2][1] > 0
    assert figures(df.withColumn("bin", df.bin.substr(1, 3)))[1][2] > 0
    assert figures(df.withColumn("bin_start", df.bin_start + 1))[2][4] > 0


def test_the_same_packing_from_other_files(spark, packed):
    texts, df = packed
    again = spark.createDataFrame([(*t, None, None, None) for t in texts[::-1]], SCHEMA).repartition(7)
    kinds = spark.createDataFrame([(2, 300), (1, 64)], "container_id long, capacity_tokens int")
    same = lambda x: sorted(map(tuple, x.collect()), key=repr)
    assert same(pack(again, kinds, block_items=50)) == same(df)


def test_little_space_is_left(packed):
    for r in fill(packed[1]).collect():
        assert r.bins <= r.least_bins * 1.06 + 1


def test_empty_table(spark, packed):
    df = spark.createDataFrame([], SCHEMA)
    none = pack(spark.createDataFrame([(1, "a b", None, None, None)], SCHEMA), spark.createDataFrame([(1, None), (2, 0)], "container_id long, capacity_tokens int"))
    assert none.count() == 0 and none.columns == packed[1].columns
    assert pack(df, spark.createDataFrame([(1, 64)], "container_id long, capacity_tokens int")).count() == 0
