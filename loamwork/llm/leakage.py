"""Evaluation passages inside a training corpus.

A generalised suffix automaton over the words of all items is streamed along
each document's words: at every word the length of the longest passage that
ends there and stands in some item is known. Passages of ``min_words`` or more
are leaks. Only runs of words that items know at all are walked; between them
the automaton is in its start state anyway.

Words are compared as a reader sees them: tags and entities resolved, without
accents, case, invisible characters and line-end hyphens, wide and joined
letters spelled out.

Defined results: null and blank texts hold nothing; items of fewer than
``min_words`` words leak nowhere; repeated items each count; copies of a
document are each reported; texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loamwork.storage import drop, settle

ATTRIBUTE = r"""\s+[\w:.-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)"""
TAG = re.compile(rf"<!--.*?-->|</?([A-Za-z][A-Za-z0-9]*)(?:{ATTRIBUTE})*\s*/?>", re.S)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var wbr".split())
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?")

def _class(*ranges: tuple[int, int]) -> str:
    """Character class of ranges of code points."""
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


#: Code points that show nothing. White space isn't among them, and the soft hyphen comes after line ends.
INVISIBLE = re.compile(
    _class(
        (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
        (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
    )
)
#: Hyphens that may end a line, and the ends of lines.
HYPHEN = _class((0x2D, 0x2D), (0xAD, 0xAD), (0x2010, 0x2011), (0xAC, 0xAC), (0xFE63, 0xFE63), (0xFF0D, 0xFF0D))
BLANK, LINE_END = _class((0x20, 0x20), (0x09, 0x09), (0xA0, 0xA0)), _class((0x0A, 0x0D), (0x85, 0x85), (0x2028, 0x2029))
BROKEN = re.compile(rf"{HYPHEN}(?<=[^\W_].){BLANK}*(?:\r\n|{LINE_END}){BLANK}*(?=[^\W_])", re.S)
#: Combining marks that are accents.
MARKS = re.compile(_class((0x300, 0x36F), (0x483, 0x489), (0x591, 0x5BD), (0x5BF, 0x5BF), (0x5C1, 0x5C2), (0x5C4, 0x5C5), (0x5C7, 0x5C7), (0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F)))
SOFT_HYPHEN = chr(0xAD)
#: Joined and barred letters that have no decomposition.
LETTERS = {"æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i", "ð": "d", "þ": "th", "ŋ": "n", "ĸ": "k"}
LETTER = re.compile(f"[{''.join(LETTERS)}]")
WORD = re.compile(r"[^\W_]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")
#: In a text of ASCII alone: an invisible character, or a hyphen at a line end.
ASCII_ODD = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]|-[ \t]*[\n-\r]")


def _tag(m: re.Match) -> str:
    name = (m[1] or "b").lower()
    return "" if name in INLINE else "\n"


def _letters(text: str) -> str:
    return LETTER.sub(lambda m: LETTERS[m[0]], text)


def words(text: str | None) -> list[str]:
    """Words of a text in the form in which they compare."""
    if not text:
        return []
    if "<" in text:
        text = TAG.sub(_tag, text)
    if "&" in text:
        text = html.unescape(text)
        if "&" in text and ENTITY.search(text):
            text = html.unescape(text)
    if text.isascii():
        if ASCII_ODD.search(text):
            text = BROKEN.sub("", INVISIBLE.sub("", text))
        return ASCII_WORD.findall(text.lower())
    text = BROKEN.sub("", INVISIBLE.sub("", text)).replace(SOFT_HYPHEN, "")
    text = unicodedata.normalize("NFKD", text.casefold()).lower()
    if text.isascii():
        return ASCII_WORD.findall(text)
    return WORD.findall(_letters(MARKS.sub("", text)))


def spans(text: str) -> list[tuple[str, int, int]]:
    """Words with the stretch of the original text that shows each.

    Slower than ``words``; for texts in which something was found.
    """
    seen: list[tuple[str, int, int]] = []  # visible characters with their origin

    def emit(s: str, a: int, b: int) -> None:
        seen.extend((c, a, b) for c in s)

    at = 0
    for m in TAG.finditer(text):
        for i in range(at, m.start()):
            emit(text[i], i, i + 1)
        emit(_tag(m), m.start(), m.end())
        at = m.end()
    for i in range(at, len(text)):
        emit(text[i], i, i + 1)
    for _ in range(2):
        flat, out, at = "".join(c for c, _, _ in seen), [], 0
        for m in ENTITY.finditer(flat):
            plain = html.unescape(m[0])
            if plain != m[0]:
                out += seen[at : m.start()]
                out += [(c, seen[m.start()][1], seen[m.end() - 1][2]) for c in plain]
                at = m.end()
        seen = out + seen[at:]
    seen = [x for x in seen if not INVISIBLE.match(x[0])]
    flat, out, at = "".join(c for c, _, _ in seen), [], 0
    for m in BROKEN.finditer(flat):
        out += seen[at : m.start()]
        at = m.end()
    seen = [x for x in out + seen[at:] if x[0] != "\u00ad"]
    folded: list[tuple[str, int, int]] = []
    for c, a, b in seen:
        folded += [(x, a, b) for x in _letters(MARKS.sub("", unicodedata.normalize("NFKD", c.casefold()).lower()))]
    flat = "".join(c for c, _, _ in folded)
    return [(m[0], folded[m.start()][1], folded[m.end() - 1][2]) for m in WORD.finditer(flat)]


class ItemAutomaton:
    """Generalised suffix automaton of the items' words; at most two states a word.

    With ``ready`` the items' texts are words in comparable form already, with single spaces.
    """

    def __init__(self, items: list[tuple[int, str | None]], min_words: int, ready: bool = False) -> None:
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, set[int]] = {}
        self.sizes: dict[int, int] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ((text or "").split() if ready else words(text))]
            self.sizes[item] = len(ids)
            last = 0
            for c in ids:
                last = self._extend(last, c)
                own.setdefault(last, set()).add(item)
        ends: list[set[int]] = [own.get(v, set()) for v in range(len(self.next))]
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if (parent := self.link[v]) > 0 and self.length[parent] >= min_words:
                ends[parent] = ends[parent] | ends[v]
        self.items = [tuple(sorted(e)) if self.length[v] >= min_words else () for v, e in enumerate(ends)]
        self.top = list(range(len(self.next)))  # the shortest suffix that is long enough has the most items
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[self.link[v]] >= min_words:
                self.top[v] = self.top[self.link[v]]

    @classmethod
    def of(cls, state: dict) -> ItemAutomaton:
        """The automaton of a broadcast state."""
        out = cls.__new__(cls)
        out.__dict__ = state
        return out

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, nxt: dict[int, int], length: int, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _walk(self, text_words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) where the longest passage that ends at word ``end`` has at least ``min_words`` words."""
        get, least = self.vocabulary.get, self.min_words
        ids = [get(w, 0) for w in text_words]
        if len(ids) < least:
            return
        unknown = np.flatnonzero(np.asarray(ids) == 0)
        edges = np.concatenate(([-1], unknown, [len(ids)]))
        for k in np.flatnonzero(np.diff(edges) > least):
            v = length = 0
            for at in range(edges[k] + 1, edges[k + 1]):
                c = ids[at]
                while v and c not in self.next[v]:
                    v = self.link[v]
                    length = self.length[v]
                if (q := self.next[v].get(c)) is not None:
                    v, length = q, length + 1
                if length >= least:
                    yield at, length, v

    def matches(self, text_words: list[str]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(end, length, items) of all items that hold the last ``min_words`` words before ``end`` or more."""
        for at, length, v in self._walk(text_words):
            yield at, length, self.items[self.top[v]] if self.length[self.link[v]] >= self.min_words else self.items[v]

    def longest(self, text_words: list[str]) -> dict[int, int]:
        """The longest passage of each item that the text holds.

        An item that lacks the whole match may hold a suffix of it: the states on the way of suffix links
        are the suffixes with more items, each item counting where it first comes up.
        """
        found: dict[int, int] = {}
        for _, n, v in self._walk(text_words):
            while True:
                for i in self.items[v]:
                    if found.get(i, 0) < n:
                        found[i] = n
                v = self.link[v]
                n = self.length[v]
                if n < self.min_words:
                    break
        return found


def _normalised(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, words, n): the words of each text that isn't null, in comparable form, and their number; ``row`` tells texts of one key apart."""
    kind = dict(df.dtypes)[key]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(w) for w in found], pa.string()), pa.array([len(w) for w in found], pa.int32())], ["key", "row", "words", "n"])

    return df.where(F.col(text).isNotNull()).select(F.col(key), F.xxhash64(text), F.col(text)).mapInArrow(make, f"key {kind}, row long, words string, n int")


def _blocks(items: DataFrame, item_id: str, item_text: str, max_words: int) -> tuple[int, Iterator[list[tuple[int, str | None]]]]:
    """Number of blocks, and one block after another: items whose words are about ``max_words``."""
    ready = settle(_normalised(items, item_id, item_text), "items")
    total = ready.agg(F.sum("n")).first()[0] or 0
    n = -(-total // max_words) or 1
    block = F.pmod(F.xxhash64("key"), F.lit(n))
    return n, ([tuple(r) for r in ready.where(block == i).select("key", "words").collect()] for i in range(n))


def _scan(docs: DataFrame, schema: str, rows_of: Callable[[ItemAutomaton, tuple], list[tuple]], items: list, min_words: int) -> tuple[DataFrame, Broadcast]:
    """Rows that ``rows_of`` makes of each row of ``docs`` with the automaton of one block."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(ItemAutomaton(items, min_words, True)))
    names = [f.name for f in docs.sparkSession.createDataFrame([], schema).schema.fields]
    types = [to_arrow_type(f.dataType) for f in docs.sparkSession.createDataFrame([], schema).schema.fields]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ItemAutomaton.of(shared.value)
        for b in batches:
            rows = [r for x in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in rows_of(automaton, x)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.mapInArrow(scan, schema), shared


def _by_block(docs: DataFrame, blocks: Iterator[list], schema: str, rows_of: Callable[[ItemAutomaton, tuple], list[tuple]], min_words: int) -> DataFrame:
    """Rows of all blocks. Each block is matched, its rows written and its automaton released before the next is made."""
    out = None
    for items in blocks:
        found, shared = _scan(docs, schema, rows_of, items, min_words)
        one = settle(found, "leaks")
        shared.destroy()
        out = one if out is None else out.union(one)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", min_words: int = 12, max_words: int = 200_000) -> DataFrame:
    """(doc_id, item_id, longest_words, item_share): documents that hold a passage of an item.

    ``longest_words`` is the length of the item's longest passage in the document, ``item_share`` its share of the item.
    Items are a stated set; an automaton holds about ``max_words`` of their words, so at most twice as many states of
    some 600 bytes. More words go in blocks, one at a time, for which the documents are normalised once.
    """
    types, item_types = dict(docs.dtypes), dict(items.dtypes)
    schema = f"`{doc_id}` {types[doc_id]}, `{item_id}` {item_types[item_id]}, longest_words int, item_share double"
    n, blocks = _blocks(items, item_id, item_text, max_words)
    leaks = lambda automaton, doc, w: [(doc, i, k, k / automaton.sizes[i]) for i, k in automaton.longest(w).items()]
    if n == 1:
        return _scan(docs.select(doc_id, text).where(F.col(text).isNotNull()), schema, lambda a, x: leaks(a, x[0], words(x[1])), next(blocks), min_words)[0]
    ready = settle(_normalised(docs, doc_id, text).where(F.col("n") >= min_words).select("key", "words"), "words")
    out = _by_block(ready, blocks, schema, lambda a, x: leaks(a, x[0], x[1].split()), min_words)
    drop(ready)
    return out


def _cut(text: str, hits: list[tuple[int, int]], max_share: float) -> tuple[int, int, str | None]:
    """(spans, characters, text) after the stretches from word to word are taken out."""
    at = spans(text)
    merged: list[list[int]] = []
    for f, t in sorted({(at[first][1], at[last][2]) for first, last in hits}):
        if merged and f <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], t)
        else:
            merged.append([f, t])
    gone = sum(e - s for s, e in merged)
    kept, end = [], 0
    for s, e in merged:
        kept.append(text[end:s])
        end = e
    return len(merged), gone, "".join([*kept, text[end:]]) if gone <= max_share * len(text) else None


def remove_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", min_words: int = 12, max_share: float = 0.5, max_words: int = 200_000) -> DataFrame:
    """(doc_id, removed_spans, removed_chars, text) of the documents with leaks.

    Spans of ``min_words`` or more are cut out; ``text`` is null where they are more than
    ``max_share`` of the text, so that the document had better go as a whole.
    With one block of items (see ``find_leaks``) all is done in the scan of the documents; with several, the places
    of all blocks are joined to a document's text before it is cut.
    """
    types = dict(docs.dtypes)
    schema = f"`{doc_id}` {types[doc_id]}, removed_spans int, removed_chars int, text string"
    n, blocks = _blocks(items, item_id, item_text, max_words)
    hits = lambda automaton, w: [(end - length + 1, end) for end, length, _ in automaton._walk(w)]
    if n == 1:

        def cut(automaton: ItemAutomaton, x: tuple) -> list[tuple]:
            found = hits(automaton, words(x[1]))
            return [(x[0], *_cut(x[1], found, max_share))] if found else []

        return _scan(docs.select(doc_id, text).where(F.col(text).isNotNull()), schema, cut, next(blocks), min_words)[0]
    ready = settle(_normalised(docs, doc_id, text).where(F.col("n") >= min_words).select("key", "row", "words"), "words")
    found = _by_block(ready, blocks, f"`{doc_id}` {types[doc_id]}, row long, f int, t int", lambda a, x: [(x[0], x[1], *h) for h in hits(a, x[2].split())], min_words)
    drop(ready)
    # at most one place for each word of a text
    places = found.groupBy(doc_id, "row").agg(F.collect_set(F.struct("f", "t")).alias("places"))

    def cut_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *_cut(t, [(h["f"], h["t"]) for h in at], max_share)) for d, t, at in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            d, k, g, t = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, b.column(0).type), pa.array(k, pa.int32()), pa.array(g, pa.int32()), pa.array(t, pa.string())], ["d", "n", "g", "k"])

    keyed = docs.select(F.col(doc_id), F.col(text).alias("__text")).where("__text is not null").withColumn("row", F.xxhash64("__text"))
    # rows of a null id are told apart by their text alone
    return keyed.join(places.withColumnRenamed(doc_id, "__id"), F.col(doc_id).eqNullSafe(F.col("__id")) & (keyed["row"] == places["row"])).select(doc_id, "__text", "places").mapInArrow(cut_joined, schema)
