"""Long exact spans shared between records.

A log-structured fingerprint index. Each batch of texts gives window hashes:
of every ``span - gram + 1`` consecutive windows of ``gram`` characters the
least is kept, so two texts with ``span`` characters in common share a kept
window at the same place of the span. The hashes of a batch become an
immutable run, bucketed and sorted on the hash, and are merge-joined with
themselves and with the runs of former batches, without moving those. Runs of
like size are compacted before the next batch, so there are few runs and each
hash is rewritten a logarithmic number of times.

Matches at one offset are chained, and each chain is verified: the digest of
its text must be equal, and the characters before and after it are compared
one by one, which also gives the span's true ends.

The texts are read once and kept beside the index, bucketed by the task that read
them, so that no text is ever shuffled: where texts are needed again, the places
asked for are sent to them. An index with a path outlives the application.

Equal texts are one class: their hashes and their text are kept once, their text is looked up
once, and classes are expanded only in the result. Hashes that stand in more than ``hot`` places -
a formula that many texts hold - aren't joined with each other; their places
are told apart by all windows of ``span`` characters around them, which two
texts share only if they belong together.

Defined results: null texts and texts shorter than ``span`` share nothing; a
span within one text doesn't count; texts are read whole, and long ones in
overlapping pieces; repeated rows of a document are one; a document without an
id counts as another's other text, but is in no pair and given no share of its own; empty tables give no
rows. Other columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamwork.storage import Run, RunStore, drop, settle, shuffle_partitions

PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        with np.errstate(over="ignore"):
            for name, base in (("p", BASE), ("i", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps)
    return _powers["p"], _powers["i"]


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` code points, by a polynomial modulo 2^64 and a mixing step."""
    power, inverse = _tables(len(codes) + 1)
    with np.errstate(over="ignore"):
        v = codes.astype(np.uint64)
        v += np.uint64(0x632BE59BD9B4E019)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        v *= power[: len(v)]
        sums = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v, out=sums[1:])
        h = sums[size:] - sums[:-size]
        h *= inverse[: len(h)]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash of each ``width`` consecutive ones, the rightmost of equals."""
    n = len(hashes)
    keys = (hashes & np.uint64(0xFFFFFFFFFFF00000)) | (np.uint64(0xFFFFF) - np.arange(n, dtype=np.uint64))
    rows = -(-n // width)
    padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keys
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def fingerprints(texts: list[str], span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, hash) of the kept windows of all texts of at least ``span`` characters."""
    width = span - gram + 1
    numbers, places, kept = [], [], []
    pieces: list[tuple[int, int, str]] = []
    for i, t in enumerate(texts):
        pieces += [(i, at, t[at : at + PIECE]) for at in range(0, len(t) - span + 1, PIECE - span + 1)]
    group: list[tuple[int, int, str]] = []
    held = 0

    def flush() -> None:
        joined = "".join(t for _, _, t in group)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        h = window_hashes(codes, gram)
        least = winnow(h, width)
        lengths = np.array([len(t) for _, _, t in group])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        of = np.repeat(np.arange(len(group)), lengths)[: len(least)]
        whole = np.arange(len(least)) - starts[of] + span <= lengths[of]
        least, of = least[whole], of[whole]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
        least, of = least[new], of[new]
        at = (np.uint64(0xFFFFF) - (least & np.uint64(0xFFFFF))).astype(np.int64)
        numbers.append(np.array([i for i, _, _ in group])[of])
        places.append(at - starts[of] + np.array([s for _, s, _ in group])[of])
        kept.append(h[at])

    for p in pieces:
        if group and held + len(p[2]) > PIECE:
            flush()
            group, held = [], 0
        group.append(p)
        held += len(p[2])
    if group:
        flush()
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(numbers), join(places), join(kept)


def _slots(spark: SparkSession, buckets: int) -> list[int]:
    """A number of each bucket, in order: rows marked with it go to that bucket when the table is bucketed by the mark."""
    rows = spark.range(buckets * 40 + 1000).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(buckets)).alias("b")).agg(F.min("v").alias("v")).orderBy("b").collect()
    if len(rows) < buckets:
        raise ValueError(f"{buckets} buckets are too many")
    return [r.v for r in rows]


def _stored(docs: DataFrame, seed: int, span: int, gram: int, slots: list[int]) -> DataFrame:
    """(slot, cls, doc, n, digest, text, prints) of texts (doc, text) of at least ``span`` characters.

    ``slot`` is the bucket of the task that read the row, so that the texts are bucketed where
    they are. ``text`` and its window hashes are given once for a class and task, else null.
    """
    long = docs.where(F.length("text") >= span)
    marked = long.select(F.spark_partition_id().alias("task"), F.xxhash64(F.lit(seed), "text").alias("cls"), "doc", F.length("text").alias("n"), F.unhex(F.md5("text")).alias("digest"), "text")
    kind = marked.schema["doc"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            classes = b.column(1).to_pylist()
            first = {c: i for i, c in reversed(list(enumerate(classes))) if c not in met}
            met.update(first)
            rows = sorted(first.values())
            kept = np.zeros(len(classes), bool)
            kept[rows] = True
            texts = [t if k else None for t, k in zip(b.column(5).to_pylist(), kept, strict=True)]
            number, place, h = fingerprints([texts[i] for i in rows], span, gram)
            at = np.searchsorted(number, np.arange(len(rows) + 1))  # text numbers come in order
            prints: list[bytes | None] = [None] * len(texts)
            for k, i in enumerate(rows):
                s, e = at[k], at[k + 1]
                prints[i] = h[s:e].astype("<u8").tobytes() + place[s:e].astype("<i4").tobytes()
            slot = [slots[t % len(slots)] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), *b.columns[1:5], pa.array(texts, pa.string()), pa.array(prints, pa.binary())], ["slot", "cls", "doc", "n", "digest", "text", "prints"])

    return marked.mapInArrow(make, f"slot int, cls long, doc {kind}, n int, digest binary, text string, prints binary")


def _postings(prints: DataFrame) -> DataFrame:
    """(fp, cls, pos) of (cls, prints)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(1).to_pylist()
            sizes = np.array([len(p) // 12 for p in packed], np.int64)
            if sizes.sum():
                h = np.concatenate([np.frombuffer(p, "<u8", n) for p, n in zip(packed, sizes, strict=True)])
                place = np.concatenate([np.frombuffer(p, "<i4", n, 8 * n) for p, n in zip(packed, sizes, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(np.array(b.column(0).to_pylist(), np.int64), sizes)), pa.array(place.astype(np.int32))], ["fp", "cls", "pos"])

    return prints.select("cls", "prints").mapInArrow(make, "fp long, cls long, pos int")


@contextlib.contextmanager
def _where_the_runs_are(spark: SparkSession) -> Iterator[None]:
    """Joins with bucketed runs leave these where they are, though they compare more columns than the runs are bucketed by."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    former = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, former)


def _wide_windows(asked: DataFrame, span: int, gram: int) -> DataFrame:
    """(fp, cls, pos) of all windows of ``span`` characters that hold the window at one of the places asked for."""
    slack = span - gram

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, t, where in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                starts = np.unique(np.concatenate([np.arange(max(0, p - slack), min(p, len(t) - span) + 1) for p in where]))
                if len(starts):
                    first = int(starts[0])
                    codes = np.frombuffer(t[first : int(starts[-1]) + span].encode("utf-32-le"), np.uint32)
                    h = window_hashes(codes, span)[starts - first]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), cls)), pa.array(starts.astype(np.int32))], ["fp", "cls", "pos"])

    return asked.mapInArrow(make, "fp long, cls long, pos int")


def _chains(matches: DataFrame, gram: int) -> DataFrame:
    """(a, b, shift, start, size) of maximal chains of matched windows at one shift; ``size`` is what they cover in a."""
    one = matches.select("a", "p", "b", (F.col("q") - F.col("p")).alias("shift"), "size")
    grouped = one.groupBy("a", "b", "shift").agg(F.array_sort(F.collect_set(F.struct(F.col("p").alias("p"), (F.col("p") + F.col("size")).alias("e")))).alias("m"))
    empty = F.expr("cast(array() as array<struct<p:int,e:int>>)")

    def add(acc, x):  # noqa: ANN001, ANN202
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["p"].alias("p"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] >= x["p"]), grown).otherwise(F.concat(acc, F.array(x)))

    chained = grouped.select("a", "b", "shift", F.explode(F.aggregate("m", empty, add)).alias("c"))
    return chained.select("a", "b", "shift", F.col("c.p").alias("start"), (F.col("c.e") - F.col("c.p")).alias("size"))


def _context(asked: DataFrame, slack: int) -> DataFrame:
    """(slot, cls, start, size, before, digest, after): text around and digest of the stretches (start, size) asked for."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cls, t, where, slot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for w in where:
                    s, e = w["start"], w["start"] + w["size"]
                    digest = hashlib.blake2b(t[s:e].encode(), digest_size=16).digest()
                    rows.append((slot, cls, s, w["size"], t[max(0, s - slack) : s], digest, t[e : e + slack]))
            if rows:
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["slot", "cls", "start", "size", "before", "digest", "after"])

    return asked.mapInArrow(make, "slot int, cls long, start int, size int, before string, digest binary, after string")


def _verify(chains: DataFrame, index: SpanIndex) -> DataFrame:
    """(a, start_a, b, start_b, size) of the true maximal spans of at least ``span`` characters.

    What stands around a stretch is taken where its text lies and stays there; the chains come to it, and
    take what stands around the stretch in ``a`` along to the one in ``b``.
    """
    span, slack = index.span, index.span - index.gram
    left = chains.select(F.col("a").alias("cls"), "start", "size")
    right = chains.select(F.col("b").alias("cls"), (F.col("start") + F.col("shift")).alias("start"), "size")
    asked = index.asked(left.union(right), F.struct("start", "size"))
    at = index.places()
    located = chains.withColumn("start_b", F.col("start") + F.col("shift")).join(at.select(F.col("cls").alias("a"), F.col("slot").alias("slot_a")), "a").join(at.select(F.col("cls").alias("b"), F.col("slot").alias("slot_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, s, o, t, n, xb, yb, xa, ya = (c.to_pylist() for c in b.columns)
            rows = []
            for i in range(len(a)):
                back = len(os.path.commonprefix([xb[i][::-1], yb[i][::-1]]))
                size = back + n[i] + len(os.path.commonprefix([xa[i], ya[i]]))
                if size >= span:
                    rows.append((a[i], s[i] - back, o[i], t[i] - back, size))
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["a", "start_a", "b", "start_b", "size"])

    with _where_the_runs_are(chains.sparkSession):
        around = Run(_context(asked, slack), "slot", index.buckets, "context", placed=True, sort=False)
        x = around.df().select(F.col("slot").alias("slot_a"), F.col("cls").alias("a"), "start", "size", F.struct("before", "digest", "after").alias("x"))
        y = around.df().select(F.col("slot").alias("slot_b"), F.col("cls").alias("b"), F.col("start").alias("start_b"), "size", F.struct("before", "digest", "after").alias("y"))
        both = located.join(x, ["slot_a", "a", "start", "size"]).join(y, ["slot_b", "b", "start_b", "size"]).where("x.digest = y.digest")
        flat = both.select("a", "start", "b", "start_b", "size", F.col("x.before"), F.col("y.before").alias("yb"), F.col("x.after"), F.col("y.after").alias("ya"))
        verified = settle(flat.mapInArrow(check, "a long, start_a int, b long, start_b int, size int"), "verified")
    around.drop()
    return verified


class ClassClash(ValueError):
    """Two different texts have the same class number; the index has to be built with another seed."""


class SpanIndex:
    """Runs of window hashes of all texts absorbed so far, and the texts themselves.

    With ``path`` the index is kept there, and opened again by a later session; its parameters
    are then those it was made with. As many buckets as the session has shuffle partitions, unless given.
    Kinds of runs: ``texts``, in the bucket of the task that read them; ``classes`` (cls, digest, doc, slot, batch), the place of
    each class's text; ``hashes`` (fp, cls, pos, batch); ``hot`` (fp) and ``wide`` (fp, cls, pos), the windows of hot hashes' places.
    """

    def __init__(self, spark: SparkSession, span: int = 300, gram: int = 150, buckets: int | None = None, fanout: int = 2, hot: int = 1000, seed: int = 0, path: str | None = None) -> None:
        self.spark, self.fanout, self.hot = spark, fanout, hot
        self.store = RunStore(spark, path, {"span": span, "gram": gram, "buckets": buckets or shuffle_partitions(spark), "seed": seed}, "spans")
        self.span, self.gram, self.buckets, self.seed = (self.store.settings[k] for k in ("span", "gram", "buckets", "seed"))
        self.slots = _slots(spark, self.buckets)

    @property
    def number(self) -> int:
        """Number of the batch that is being absorbed."""
        return self.store.version

    def compact(self, *kinds: str) -> None:
        """Merge runs of like size, bucket by bucket, without moving them."""
        with _where_the_runs_are(self.spark):
            for kind in kinds:
                self.store.compact(kind, self.fanout, _merged, placed=True)

    def places(self) -> DataFrame:
        """(cls, slot) of all classes."""
        return _union([r.df().select("cls", "slot") for r in self.store.of("classes")])

    def asked(self, places: DataFrame, place: Column) -> DataFrame:
        """(cls, text, places, slot) of the classes in ``places``: one text each, read where it lies.

        A class has at most one place for each character of its text. The places move, the texts don't.
        """
        grouped = places.groupBy("cls").agg(F.collect_set(place).alias("places"))
        located = None
        for r in self.store.of("classes"):
            one = r.df().select("cls", "doc", "slot").join(grouped, "cls")
            located = one if located is None else located.union(one)
        runs = self.store.of("texts")
        located = (settle(located, "places") if len(runs) > 1 else located).select("slot", "cls", "doc", "places")
        out = None
        for r in runs:
            texts = r.df().where("text is not null").select("slot", "cls", "doc", "text")
            # a row that comes again in the same bucket has the same text
            one = _here(texts, located, "inner").select("cls", "text", "places", "slot")
            out = one if out is None else out.union(one)
        return out

    def _new_classes(self, texts: Run, batch: int) -> Run:
        """Run of the classes that the index didn't have, with the place of their text."""
        t = texts.df()
        one = t.groupBy("cls").agg(F.min("digest").alias("digest"), F.max("digest").alias("other"), F.min(F.when(F.col("prints").isNotNull(), F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "slot"))).alias("at")).withColumn("known", F.lit(None).cast("binary"))
        for r in self.store.of("classes"):
            one = one.join(r.df().select("cls", F.col("digest").alias("k")), "cls", "left").withColumn("known", F.coalesce("known", "k")).drop("k")
        one = settle(one, "classes")
        if not one.where("digest <> other or known <> digest").isEmpty():
            raise ClassClash("two texts have the same class number; build the index with another seed")
        return self.store.add("classes", one.where("known is null").select("cls", "digest", "at.doc", "at.slot", F.lit(batch).alias("batch")), "cls", self.buckets)

    def _absorb_hashes(self, prints: DataFrame, batch: int) -> DataFrame:
        """Add the hashes of (cls, prints) as a run; (a, p, b, q, size): matched windows of a new text and a new or former one, a < b."""
        self.compact("hashes")
        placed = _postings(prints).repartition(self.buckets, "fp").dropDuplicates(["fp", "cls", "pos"]).withColumn("batch", F.lit(batch))
        former = self.store.of("hashes")
        n = self.store.add("hashes", placed, "fp", self.buckets, placed=True).df()
        counts = n.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
        for r in former:
            # a hash of a former run counts only where the new run has it too
            counts = counts.join(r.df().groupBy("fp").agg(F.count(F.lit(1)).alias("m")), "fp", "left").select("fp", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
        hot = settle(counts.where(F.col("n") > self.hot).select("fp"), "hot")
        if hot.isEmpty():
            cool = lambda df: df
        else:
            self.touched.append(hot)
            cool = lambda df: df.join(hot, "fp", "left_anti")
        left = cool(n).select("fp", F.col("cls").alias("x"), F.col("pos").alias("p"))
        other = lambda df: df.select("fp", F.col("cls").alias("y"), F.col("pos").alias("q"))
        out = left.join(other(n), "fp").where("x < y")
        for r in former:
            out = out.union(left.join(other(r.df()), "fp").where("x <> y"))
        swapped = F.col("x") > F.col("y")
        pick = lambda a, b: F.when(swapped, F.col(b)).otherwise(F.col(a))
        return out.select(pick("x", "y").alias("a"), pick("p", "q").alias("p"), pick("y", "x").alias("b"), pick("q", "p").alias("q"), F.lit(self.gram).alias("size"))

    def _hot_matches(self, batch: int) -> DataFrame | None:
        """Matches among the places of hot hashes, by all windows of ``span`` characters around them.

        A hash that was hot before adds its new places alone; one that has become hot adds all.
        """
        if not self.touched:
            return None
        touched = _union([t for t in self.touched]).distinct()
        before = [r.df() for r in self.store.of("hot")]
        known = _union(before) if before else touched.where(F.lit(False))
        fresh = self.store.add("hot", touched.join(known, "fp", "left_anti"), "fp", self.buckets).df()
        old = touched.join(known, "fp", "left_semi")
        places = None
        for r in self.store.of("hashes"):
            h = r.df()
            one = h.join(fresh, "fp", "left_semi").select("cls", "pos").union(h.where(F.col("batch") == batch).join(old, "fp", "left_semi").select("cls", "pos"))
            places = one if places is None else places.union(one)
        asked = self.asked(places.distinct(), F.col("pos"))
        former = [r.df() for r in self.store.of("wide")]
        with _where_the_runs_are(self.spark):
            new = self.store.add("wide", _wide_windows(asked, self.span, self.gram), "fp", self.buckets).df()
        w = new.select("fp", F.col("cls").alias("x"), F.col("pos").alias("p"))
        out = None
        for side in (new, *former):
            v = side.select("fp", F.col("cls").alias("y"), F.col("pos").alias("q"))
            one = w.join(v, "fp").where("x < y" if side is new else "x <> y")
            out = one if out is None else out.union(one)
        swapped = F.col("x") > F.col("y")
        pick = lambda a, b: F.when(swapped, F.col(b)).otherwise(F.col(a))
        return out.select(pick("x", "y").alias("a"), pick("p", "q").alias("p"), pick("y", "x").alias("b"), pick("q", "p").alias("q"), F.lit(self.span).alias("size"))

    def absorb(self, docs: DataFrame, batches: int = 1, batch_id: str | None = None) -> DataFrame | None:
        """Add texts (doc, text) and give (a, start_a, b, start_b, size): the maximal stretches that a new class of
        equal texts has in common with another class, a < b.

        The texts are read once; their hashes are merge-joined with the index and added in ``batches`` batches. Stretches of two
        former classes may come again when a hash has become hot. ``None`` for a batch of an id absorbed before.
        """
        if batch_id is not None and batch_id in self.store.batches:
            return None
        batch, self.touched = self.number, []
        stored = _stored(docs, self.seed, self.span, self.gram, self.slots)
        texts = self.store.add("texts", stored, "slot", self.buckets, placed=True, sort=False)
        self._new_classes_run = self._new_classes(texts, batch)
        prints = texts.df().where("prints is not null").select("cls", "doc", "slot", "prints")
        if batch:  # classes of former batches are in the index already
            prints = _here(prints, self._new_classes_run.df(), "left_semi")
        matches = []
        for i in range(batches):
            found = self._absorb_hashes(prints.where(F.pmod("cls", F.lit(batches)) == i), batch)
            matches.append(settle(found, "matches"))
        hot = self._hot_matches(batch)
        chains = settle(_chains(_union([*matches, *([] if hot is None else [hot])]), self.gram), "chains")
        verified = _verify(chains, self).distinct()
        self.compact("classes", "wide", "hot")
        self.store.compact("texts", 2 * self.fanout, _union, placed=True)  # each text stays in its bucket
        self.store.publish(batch_id)
        for m in (*matches, *self.touched, chains):
            drop(m)
        return verified

    def members(self) -> DataFrame:
        """(cls, doc, n) of all texts of at least ``span`` characters."""
        return _union([r.df().select("cls", "doc", "n") for r in self.store.of("texts")])

    def close(self) -> None:
        self.store.close()


def _here(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Rows of ``texts`` joined with the places (slot, cls, doc, ...) they have; documents may lack an id."""
    other = places.select(*(F.col(c).alias(f"at_{c}" if c in ("slot", "cls", "doc") else c) for c in places.columns))
    return texts.join(other, (F.col("slot") == F.col("at_slot")) & (F.col("cls") == F.col("at_cls")) & F.col("doc").eqNullSafe(F.col("at_doc")), how)


def _merged(runs: list[DataFrame]) -> DataFrame:
    """Rows of runs of the same columns that have no row in common, merge-joined."""
    out = runs[0]
    for r in runs[1:]:
        other = r.select(*(F.col(c).alias(f"other_{c}") for c in out.columns))
        same = F.lit(True)
        for c in out.columns:
            same = same & (F.col(c) == F.col(f"other_{c}"))
        out = out.join(other, same, "full_outer").select(*(F.coalesce(c, f"other_{c}").alias(c) for c in out.columns))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def found_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 300, batches: int = 3, hot: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Members (cls, doc, n) of the classes of equal texts, and the spans that classes share.

    Where two different texts get the same class number, all is done anew with another seed.
    """
    seed = 0
    while True:
        index = SpanIndex(docs.sparkSession, span, span // 2, hot=hot, seed=seed)
        try:
            spans = index.absorb(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")), batches)
            members = settle(index.members(), "members")
        except ClassClash:
            index.store.destroy()
            seed += 1
            continue
        index.store.destroy()  # the texts go with it
        return members, spans


def sharing_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 300) -> DataFrame:
    """(doc_id_a, doc_id_b) of all documents with ``span`` or more consecutive characters in common."""
    members, spans = found_spans(docs, doc_id, text, span)
    m = members.select("cls", "doc").where("doc is not null").distinct()
    pairs = spans.select("a", "b").distinct()
    across = pairs.join(m.select(F.col("cls").alias("a"), F.col("doc").alias("x")), "a").join(m.select(F.col("cls").alias("b"), F.col("doc").alias("y")), "b").select("x", "y")
    within = m.select("cls", F.col("doc").alias("x")).join(m.select("cls", F.col("doc").alias("y")), "cls").where("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def class_members(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 300) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts: members (doc_id, class_doc_id, links) and pairs (class_a, class_b) of classes with a stretch in common.

    A class is named by its least document. ``links`` is the number of other classes that share a stretch with it. Membership and
    pairs say what ``sharing_pairs`` says without expanding copies, so a large group of copies costs a row a document.
    """
    members, spans = found_spans(docs, doc_id, text, span)
    members = members.where("doc is not null")
    firsts = settle(members.groupBy("cls").agg(F.min("doc").alias("first")), "firsts")
    named = lambda c, as_: firsts.select(F.col("cls").alias(c), F.col("first").alias(as_))
    both = settle(spans.select("a", "b").distinct().join(named("a", "x"), "a").join(named("b", "y"), "b").select("x", "y"), "pairs")
    links = both.select("x").union(both.select("y")).groupBy("x").agg(F.count(F.lit(1)).alias("links"))
    of = members.select("cls", "doc").distinct().join(firsts, "cls").join(links.withColumnRenamed("x", "first"), "first", "left")
    pairs = both.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"))
    return of.select(F.col("doc").alias(doc_id), F.col("first").alias(f"class_{doc_id}"), F.coalesce("links", F.lit(0)).alias("links")), pairs


def shared_share(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 300) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share): how much of each document stands elsewhere in spans of ``span`` or more.

    A document with an exact copy is shared as a whole. Documents without shared text are given with 0.
    """
    members, spans = found_spans(docs, doc_id, text, span)
    sides = spans.select(F.col("a").alias("cls"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("size")).alias("e")).union(spans.select("b", "start_b", F.col("start_b") + F.col("size"))).distinct()
    w = Window.partitionBy("cls").orderBy("s", "e")
    gaps = sides.withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    covered = gaps.select("cls", F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("reach", F.lit(0)))).alias("c")).groupBy("cls").agg(F.sum("c").alias("c"))
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    known = members.join(copies, "cls").join(covered, "cls", "left").select("doc", F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce("c", F.lit(0))).cast("long").alias("c"))
    out = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.length(text), F.lit(0)).alias("n")).join(known, "doc", "left")
    c = F.coalesce("c", F.lit(0).cast("long"))
    return out.select(F.col("doc").alias(doc_id), F.col("n").alias("n_chars"), c.alias("shared_chars"), F.when(F.col("n") > 0, F.round(c / F.col("n"), 6)).otherwise(0.0).alias("shared_share"))
