import random

import numpy as np
import pytest

from loamwork.llm.shared_spans import SpanIndex, fingerprints, found_spans, shared_share, sharing_pairs, window_hashes

SCHEMA = "doc_id long, text string, cls string, a string, fp string"


def docs(spark, texts):
    return spark.createDataFrame([(n, t, None, None, None) for n, t in texts], SCHEMA)


def brute(texts, span):
    at: dict = {}
    for n, t in texts:
        for i in range(len(t or "") - span + 1):
            at.setdefault(t[i : i + span], set()).add(n)
    return sorted({(x, y) for v in at.values() for x in v for y in v if x < y})


def share(texts, span):
    at: dict = {}
    for n, t in texts:
        for i in range(len(t or "") - span + 1):
            at.setdefault(t[i : i + span], set()).add(n)
    out = {}
    for n, t in texts:
        hit = set()
        for i in range(len(t or "") - span + 1):
            if len(at[t[i : i + span]]) > 1:
                hit |= set(range(i, i + span))
        out[n] = len(hit)
    return out


def text(rng, n, alphabet="abcdefghij klmnop"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def sample(seed):
    rng = random.Random(seed)
    shared = [text(rng, n) for n in (299, 300, 301, 340, 700, 160, 450)]
    texts = []
    for n in range(40):
        parts = [text(rng, rng.randrange(10, 300))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), text(rng, rng.randrange(1, 200))]
        texts.append((n, "".join(parts)))
    texts += [(100, texts[3][1]), (101, texts[3][1]), (102, None), (103, ""), (104, "x" * 299), (105, "y" * 2000), (106, "y" * 300), (107, "ü" * 300 + "𝄞" * 10), (108, "𝄞" + "ü" * 300), (109, "ab" * 400), (110, "ba" * 300)]
    return texts


def test_pairs_and_shares_against_brute_force(spark):
    texts = sample(1)
    df = docs(spark, texts)
    assert sorted(tuple(r) for r in sharing_pairs(df.union(df.where("doc_id < 5"))).collect()) == brute(texts, 300)
    assert sorted(tuple(r) for r in sharing_pairs(df).collect()) == brute(texts, 300)
    assert {r.doc_id: r.shared_chars for r in shared_share(df).collect()} == share(texts, 300)


def test_hot_hashes_lose_nothing(spark):
    df = docs(spark, sample(2))
    plain, hot = ({tuple(r) for r in found_spans(df, hot=h)[1].collect()} for h in (1000, 2))
    assert plain == hot and plain


def test_documents_without_an_id_hide_nothing(spark):
    common = text(random.Random(5), 400)
    df = docs(spark, [(None, common), (None, common), (1, common), (2, "x" + common), (None, "y" + common)])
    assert sorted(tuple(r) for r in sharing_pairs(df).collect()) == [(1, 2)]
    assert sorted((r.doc_id, r.shared_chars) for r in shared_share(df).where("doc_id is not null").collect()) == [(1, 400), (2, 400)]
    assert sorted(r.shared_chars for r in shared_share(docs(spark, [(None, common), (3, common + "z")])).where("doc_id is not null").collect()) == [400]


def test_texts_in_overlapping_pieces():
    rng = random.Random(3)
    long = text(rng, 700_000)
    number, place, h = fingerprints(["short", long], 300, 150)
    assert set(number) == {1} and place.max() > 690_000
    assert np.diff(np.unique(place)).max() <= 151
    codes = np.frombuffer(long[place[7] : place[7] + 150].encode("utf-32-le"), np.uint32)
    assert window_hashes(codes, 150)[0] == h[7]


def test_runs_are_compacted(spark):
    texts = [(n, text(random.Random(n), 400)) for n in range(24)]
    index = SpanIndex(spark, buckets=2)
    df = docs(spark, texts).selectExpr("doc_id as doc", "text")
    for n in range(6):
        assert index.absorb(df.where(f"doc % 6 = {n}")).count() == 0
    index.compact("hashes")
    assert len(index.store.of("hashes")) <= 3
    doc_of = {r.cls: r.doc for r in index.members().collect()}
    places = {(doc_of[r.cls], r.pos) for run in index.store.of("hashes") for r in run.df().collect()}
    number, place, _ = fingerprints([t for _, t in texts], 300, 150)
    assert places == set(zip(number.tolist(), place.tolist(), strict=True))


@pytest.mark.parametrize("hot", [1000, 2])
def test_an_index_outlives_its_session_and_an_interrupted_batch(spark, tmp_path, hot):
    texts = sample(3)
    df = docs(spark, texts).selectExpr("doc_id as doc", "text")
    path, found = f"file://{tmp_path}/index", set()
    for n in range(3):
        index = SpanIndex(spark, buckets=3, hot=hot, path=path)
        part = df.where(f"doc % 3 = {n}")
        found |= {tuple(r) for r in index.absorb(part, batch_id=f"b{n}").collect()}
        assert index.absorb(part, batch_id=f"b{n}") is None  # delivered twice
        index.store.add("hashes", spark.createDataFrame([(1, 1, 1, 9)], "fp long, cls long, pos int, batch int"), "fp", 3)  # never published
        index.close()
    kept = SpanIndex(spark, hot=hot, path=path)
    assert kept.buckets == 3 and kept.number == 3 and len(kept.store.of("texts")) == 3
    whole = {tuple(r) for r in found_spans(docs(spark, texts), hot=hot)[1].collect()}
    assert found == whole and whole
    # two copies of a text told before bring nothing new
    again = [(900, texts[3][1]), (901, texts[3][1])]
    assert kept.absorb(docs(spark, again).selectExpr("doc_id as doc", "text")).count() == 0
    assert len(kept.store.of("texts")) == 1  # merged where they are
    near = [(950, "z" + texts[3][1])]
    members = {r.cls: r.doc for r in kept.members().where("doc < 100").collect()}
    pairs = {tuple(sorted((members.get(r.a, 950), members.get(r.b, 950)))) for r in kept.absorb(docs(spark, near).selectExpr("doc_id as doc", "text")).collect()}
    assert pairs == {p for p in brute([*texts[:40], *near], 300) if 950 in p}


def test_empty_table(spark):
    assert sharing_pairs(docs(spark, [])).count() == 0
    assert shared_share(docs(spark, [(1, None), (2, "")])).count() == 2
