import os
import random

import duckdb
import pandas as pd
import pytest

from loamwork.llm.leakage import ItemAutomaton, find_leaks, remove_leaks, spans, words

ITEM = "On the third attempt, a careful technician outside Dunholm rejected twelve fine silver rings before the flood"
DOCS = "doc_id long, text string, item_id string, longest_words string"
ITEMS = "item_id long, item_text string, doc_id string"


@pytest.mark.parametrize(
    "text",
    [
        "One two, THREE fine flow", "Óne twö thrèe fine flow", "one <b>t</b>wo<br/>three fine flow", "<p>one</p><p>two</p>three fine flow", "one&nbsp;two th&#114;ee &#102;ine flow", "o​ne two thr­ee fine flow",
        "one t-\nwo three fi-\r\n  ne flow", "one two three ﬁne ﬂow", "ｏｎｅ two three fine flow", "one [two] “three” *fine* (flow)", "one two\tthree\x0bfine　flow", "one tw­\no three fine flow",
        "óne two three fine flow", "one <i class='x y'>two</i> three<!-- four --> fine flow", "one two &amp;#116;hree fine flow", "𝐨ne two three fine flow", "o\x00ne two three fine flow",
    ],
)
def test_words_as_a_reader_sees_them(text):
    assert words(text) == ["one", "two", "three", "fine", "flow"]
    assert [w for w, _, _ in spans(text)] == words(text)


def test_more_words():
    assert words("Straße cœur Łódź a<b c>d x < y") == ["strasse", "coeur", "lodz", "a", "b", "c", "d", "x", "y"]
    assert words(None) == words("") == words(" \n") == []
    assert words("snake_case a1b2") == ["snake", "case", "a1b2"]


def brute(docs, items, least):
    out = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        for i, s in items:
            v = words(s)
            if any(tuple(v[k : k + least]) in grams for k in range(len(v) - least + 1)):
                out.add((d, i))
    return out


def test_automaton_against_brute_force():
    rng = random.Random(4)
    for least in (2, 3, 5):
        for _ in range(60):
            text = lambda n: " ".join(rng.choice("abcx" if rng.random() < 0.9 else "z") for _ in range(n))
            items = [(n, text(rng.randrange(9))) for n in range(6)]
            docs = [(n, text(rng.randrange(30))) for n in range(6)]
            automaton = ItemAutomaton(items, least)
            assert {(d, i) for d, t in docs for _, _, hit in automaton.matches(words(t)) for i in hit} == brute(docs, items, least)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, None, None) for d in docs], DOCS), spark.createDataFrame([(*i, None) for i in items], ITEMS)


def test_leaks_at_the_limit(spark):
    w = ITEM.split()
    docs = [(1, "x " + " ".join(w[:12]) + " y"), (2, " ".join(w[:11])), (3, " ".join([*w[:6], "new", *w[6:]])), (4, ITEM.upper()), (4, ITEM.upper()), (5, None), (6, " "), (7, "filler " * 50_000 + ITEM)]
    items = [(1, ITEM), (2, " ".join(w[:11])), (3, None), (4, ITEM), (5, " ".join(w[:12]))]
    found = find_leaks(*frames(spark, docs, items))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == sorted([*[(d, i) for d in (1, 4, 4, 7) for i in (1, 4, 5)]])
    best = {(r.doc_id, r.item_id): (r.longest_words, round(r.item_share, 3)) for r in found.collect()}
    assert best[(1, 1)] == (12, round(12 / len(words(ITEM)), 3)) and best[(4, 1)][1] == 1.0
    blocks = find_leaks(*frames(spark, docs, items), max_words=20)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, found.collect()))


def test_removal(spark):
    w = ITEM.split()
    docs = [(1, "Keep this part. " * 9 + " ".join(w[2:15]) + " And this."), (2, ITEM), (3, "nothing here")]
    out = {r.doc_id: r for r in remove_leaks(*frames(spark, docs, [(1, ITEM)])).collect()}
    assert out[1].removed_spans == 1 and out[1].text == "Keep this part. " * 9 + " And this."
    assert out[2].text is None and set(out) == {1, 2}
    more = [(n, ITEM) for n in range(1, 6)] + [(9, "Keep this part. " * 9)]
    one, many = (sorted(map(tuple, remove_leaks(*frames(spark, [*docs, (1, ITEM + " again"), (None, ITEM)], more), max_words=m).collect()), key=repr) for m in (200_000, 20))
    assert one == many and len(one) == 4


def test_longest_passage_of_each_item(spark):
    long, other = [f"a{n}" for n in range(40)], [f"b{n}" for n in range(50)]
    items = [(1, " ".join(long)), (2, " ".join(other + long[-12:])), (3, " ".join(long[5:30] + other[:3]))]
    found = {r.item_id: (r.longest_words, round(r.item_share, 4)) for r in find_leaks(*frames(spark, [(7, " ".join(long))], items)).collect()}
    assert found == {1: (40, 1.0), 2: (12, round(12 / 62, 4)), 3: (25, round(25 / 28, 4))}
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    for _ in range(150):
        items = [(n, text(rng.randrange(12))) for n in range(5)]
        doc = text(25).split()
        want = {}
        for n, t in items:
            w = t.split()
            runs = [k for i in range(len(w)) for k in range(3, len(w) - i + 1) if any(doc[x : x + k] == w[i : i + k] for x in range(len(doc)))]
            if runs:
                want[n] = max(runs)
        assert ItemAutomaton(items, 3).longest(doc) == want


DATA = "/root/testdata/sf0.001"
LONGEST = """
WITH d AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS p, w FROM docs WHERE len(w) >= 12), i AS (SELECT item_id, unnest(range(1, len(w) - 10)) AS q, w FROM items WHERE len(w) >= 12),
g AS (SELECT doc_id, item_id, p, p - q AS shift FROM (SELECT doc_id, p, w[p:p + 11] AS k FROM d) JOIN (SELECT item_id, q, w[q:q + 11] AS k FROM i) USING (k)),
r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS run FROM g),
n AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM r GROUP BY doc_id, item_id, shift, run)
SELECT doc_id, item_id, max(n) FROM n GROUP BY 1, 2
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_longest_passages_of_the_test_data_against_sql(spark):
    """The words are the operator's, the matching is SQL's."""
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "eval_items"))
    con = duckdb.connect()
    for name, df, key, text in (("docs", docs, "doc_id", "text"), ("items", items, "item_id", "item_text")):
        con.register(f"{name}_", pd.DataFrame([(r[0], " ".join(words(r[1]))) for r in df.select(key, text).collect()], columns=[key, "t"]))
        con.execute(f"create table {name} as select {key}, string_split(t, ' ') as w from {name}_")
    found = sorted((r.doc_id, r.item_id, r.longest_words) for r in find_leaks(docs, items).collect())
    assert found and found == sorted(con.execute(LONGEST).fetchall())


def test_empty_tables(spark):
    for docs, items in (([], [(1, ITEM)]), ([(1, ITEM)], []), ([], [])):
        assert find_leaks(*frames(spark, docs, items)).count() == 0
        assert remove_leaks(*frames(spark, docs, items)).count() == 0
