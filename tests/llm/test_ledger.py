import random

from loamwork.llm.ledger import Ledger, build_ledger, definition_keys, parsed_dependency_keys

PARSED = "parseddependencyid long, sourceserver string, sourcedatabase string, sourceschema string, sourceobject string, operationtype string, targetserver string, targetdatabase string, targetschema string, targetobject string, capturedate string, key string"
DEFS = "definitionid long, objectdefinition string, id string"


def parsed(spark, rows):
    base = ["s", "d", "dbo", "o", "SELECT", "s", "d"]
    return spark.createDataFrame([(n, *(over[0] if isinstance(over, tuple) else base), *(over[1:] if isinstance(over, tuple) else over), None, None) for n, over in rows], PARSED)


def copies(records, batches=2):
    return sorted(tuple(r) for r in build_ledger(records, batches, 4).copies(records).collect())


def test_writing_of_names_and_swapped_fields(spark):
    base = ["s", "d", "dbo", "o", "SELECT", "s", "d"]
    rows = [
        (1, (base, "dbo", "Fact_Sale")), (2, (["S ", "d", "[dbo]", "O", "select", "s", "d"], "DBO", " fact sale;")), (3, (base, "factsale", "d.b.o")), (4, (base, "dbo", "FactSales")),
        (5, (base, "db", "oFactSale")), (6, (["s", "d", "dbo", "o", "INSERT", "s", "d"], "dbo", "FactSale")), (7, (base, None, "FactSale")), (8, (base, "FACTSALE", None)), (9, (base, "", "FactSale")),
        (10, (base, "dbo", "É1")), (11, (base, "dbo", "é-1")),
    ]
    assert copies(parsed_dependency_keys(parsed(spark, rows))) == [(1, 2), (1, 3), (7, 8), (10, 11)]


def test_order_of_the_list(spark):
    # every comma separates entries, those within parentheses too (16 to 18)
    rows = [
        (9, "CREATE VIEW a.b AS SELECT x.c1, x.c2 as Q FROM t x WHERE x.a = 1"), (3, "create  view [a].[b] as select\n x.C2 as q\n ,x.c1 from t x where (x.a=1);"),
        (4, "create view a.b as select x.c1 from t x where x.a = 1"), (5, "create view a.b as select x.c1, x.c2 as q from t x where x.a = 2"), (6, "create view a.z as select x.c1, x.c2 as q from t x where x.a = 1"),
        (7, "create view a.b as select x.c1x, .c2 as q from t x where x.a = 1"), (10, None), (11, None), (12, "no list"), (13, "No  List!"), (14, ""), (15, "  "),
        (16, "create view v as select f(a, b), c from t"), (17, "create view v as select c, f(a,b) from t"), (18, "create view v as select b, f(a, c) from t"), (19, "create view a.b as select x.c1, x.c1, x.c2 as q from t x where x.a = 1"),
    ]
    assert copies(definition_keys(spark.createDataFrame([(*r, None) for r in rows], DEFS))) == [(3, 9), (12, 13), (14, 15), (16, 17), (16, 18)]


def test_very_long_definition(spark):
    names = [f"c{n}" for n in range(20_000)]
    a, b = (f"create view v as select {', '.join(x)} from t" for x in (names, names[::-1]))
    assert copies(definition_keys(spark.createDataFrame([(1, a, None), (2, b, None)], DEFS))) == [(1, 2)]


def test_batches_add_up_whatever_their_order(spark):
    rng = random.Random(2)
    data = [(f"k{rng.randrange(30) if rng.random() < 0.6 else 0}".encode(), n) for n in range(300)]
    rng.shuffle(data)
    ledger = Ledger(spark, 4)
    for part in (data[:100], data[100:101], [], data[101:]):
        ledger.absorb(spark.createDataFrame(part, "key binary, id long"))
    want: dict = {}
    for k, n in data:
        want.setdefault(k, []).append(n)
    assert sorted((bytes(r.key), r.first_id, r.copies) for r in ledger.df().collect()) == sorted((k, min(v), len(v)) for k, v in want.items())
    records = spark.createDataFrame(data, "key binary, id long")
    assert sorted(tuple(r) for r in ledger.copies(records).collect()) == sorted((min(v), n) for v in want.values() for n in v if n != min(v))


def test_a_ledger_outlives_its_session_and_an_interrupted_batch(spark, tmp_path):
    rng = random.Random(6)
    data = [(f"k{rng.randrange(40)}".encode(), n) for n in range(300)]
    parts = [data[:150], data[150:290], data[290:]]
    frame = lambda rows: spark.createDataFrame(rows, "key binary, id long")
    path = f"file://{tmp_path}/ledger"
    sizes = []
    for n, part in enumerate(parts):
        ledger = Ledger(spark, 4, path)
        sizes.append(ledger.absorb(frame(part), f"b{n}"))
        assert ledger.absorb(frame(part), f"b{n}") == 0  # delivered twice
        ledger.store.add("keys", frame(data), "key", 4)  # a batch that is never published
        ledger.store.close()
    assert all(sizes)
    kept, whole = Ledger(spark, None, path), build_ledger(frame(data), 1, 4)
    assert kept.buckets == 4 and kept.store.batches == ["b0", "b1", "b2"]
    assert len(kept.store.of("keys")) == 2 and len(list((tmp_path / "ledger" / "runs").iterdir())) == 2
    same = lambda x: sorted((bytes(r.key), r.first_id, r.copies) for r in x.df().collect())
    assert same(kept) == same(whole)
    assert sorted(map(tuple, kept.copies(frame(data)).collect())) == sorted(map(tuple, whole.copies(frame(data)).collect()))


def test_empty_table(spark):
    assert copies(spark.createDataFrame([], "key binary, id long")) == []
