"""Several values packed in one field, split to one row each.

Dictionary-guided segmentation. A multi-pattern automaton finds whole values
known from cleanly written fields; together with what the grammar allows at a
place (a run of name characters, a quoted name, a separator) they make a graph
over the text's positions, and dynamic programming takes the best cover: least
name characters and marks left out or missing, then most known values, then fewest
pieces. In a well-written field the grammar alone costs nothing, so the
dictionary decides only where a value has one of its marks and lacks the
other, or marks are stray; delimiters inside a quoted value are never
separators, and names without any mark are never joined.

Defined results: null, empty and separator-only fields give no rows; repeated
names stay; empty quotes are no name; equal texts give equal results. Time and memory grow
with a text's length, the number of known values found in it and the length of
its quoted names. Other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.storage import drop, settle

CLOSING = {"[": "]", '"': '"', "'": "'", "`": "`"}
EXTRA = "_$#@"


def _is_name(c: str) -> bool:
    return c in EXTRA or c.isalpha() or unicodedata.category(c) in ("Nd", "Mn", "Mc")


def _lowered(text: str) -> str:
    """Lower case, place by place; a letter whose lower form has another length stays as it is."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text)


_QUOTED = "|".join(rf"{re.escape(a)}(?:[^{re.escape(b)}]|{re.escape(b)}{re.escape(b)})+{re.escape(b)}(?!{re.escape(b)})" for a, b in CLOSING.items())
_BARE = r"[^\W_]|[_$#@]"
_TOKEN = re.compile(rf"({_QUOTED})|((?:{_BARE}|[^\x00-\x7f])+)|(.)", re.S)


def _unquote(s: str) -> str:
    close = CLOSING[s[0]]
    return s[1:-1].replace(close * 2, close)


def clean_values(text: str | None) -> list[str] | None:
    """Values of a field that the grammar reads without remainder, else ``None``."""
    out: list[str] = []
    for quoted, run, other in _TOKEN.findall(text or ""):
        if quoted:
            out.append(_unquote(quoted))
        elif run:
            word = ""
            for c in run:
                if _is_name(c):
                    word += c
                elif word:
                    out.append(word)
                    word = ""
            if word:
                out.append(word)
        elif other in "[]\"'`":
            return None
    return out


class Segmenter:
    """Splits fields; ``known`` are whole values from cleanly written fields."""

    def __init__(self, known: list[str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for k in {_lowered(k) for k in known}:
            self.automaton.add_word(k, len(k))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of all known values in a text, without regard to case."""
        if not len(self.automaton):
            return []
        return [(last - size + 1, last + 1) for last, size in self.automaton.iter(_lowered(text))]

    def split(self, text: str | None, hits: list[tuple[int, int]] | None = None) -> list[str]:
        """Names of the best cover, in order; ``hits`` are the known values if they were found before."""
        text = text or ""
        n = len(text)
        known = set(self.hits(text) if hits is None else hits)
        pieces: dict[int, list[tuple[int, str | None, bool, int]]] = {}  # start -> (end, value, known, missing marks)

        def add(start: int, end: int, value: str, inner: tuple[int, int], missing: int = 0) -> None:
            # an empty pair of marks is no name, but it is no stray mark either
            pieces.setdefault(start, []).append((end, value or None, not value or inner in known, missing))

        at = 0
        while at < n:  # maximal runs of name characters
            end = at
            while end < n and _is_name(text[end]):
                end += 1
            if end > at:
                add(at, end, text[at:end], (at, end))
            at = max(end, at + 1)
        # the end of a quoted name: the first closing mark that isn't doubled
        for mark, close in CLOSING.items():
            ends: list[int] = []
            run_end = n - 1
            while run_end >= 0:
                if text[run_end] == close:
                    run = run_end
                    while run > 0 and text[run - 1] == close:
                        run -= 1
                    ends.append((run, run_end))
                    run_end = run - 1
                else:
                    run_end -= 1
            ends.reverse()
            # a run of closing marks ends a name that begins before it if their number is odd
            odd = [k for k, (run, last) in enumerate(ends) if (last - run + 1) % 2]
            k = o = 0
            for s in (i for i, c in enumerate(text) if c == mark):
                while k < len(ends) and ends[k][1] <= s:
                    k += 1
                if k < len(ends) and ends[k][0] <= s:  # within a run: what is left of it counts
                    if (ends[k][1] - s) % 2:
                        last = ends[k][1]
                        add(s, last + 1, text[s + 1 : last].replace(close * 2, close), (s + 1, last))
                        continue
                    after = k + 1
                else:
                    after = k
                while o < len(odd) and odd[o] < after:
                    o += 1
                if o < len(odd):
                    last = ends[odd[o]][1]
                    add(s, last + 1, text[s + 1 : last].replace(close * 2, close), (s + 1, last))
        for s, e in known:
            opens = s > 0 and text[s - 1] in CLOSING
            closes = e < n and text[e] in CLOSING.values()
            if closes and text[e + 1 : e + 2] == text[e]:
                continue  # a doubled mark ends nothing
            if (opens and CLOSING[text[s - 1]] in text[s:e]) or (closes and text[e] in text[s:e]):
                continue  # between marks it would be written with doubled ones
            if opens and closes and text[e] == CLOSING[text[s - 1]]:
                add(s - 1, e + 1, text[s:e], (s, e))
            elif opens and not (e < n and _is_name(text[e])):
                add(s - 1, e, text[s:e], (s, e), 1)
            elif closes and not (s > 0 and _is_name(text[s - 1])):
                add(s, e + 1, text[s:e], (s, e), 1)
        # cost: (name characters and marks left out or missing, pieces not known, pieces)
        best: list[tuple[int, int, int] | None] = [None] * (n + 1)
        back: list[tuple[int, str | None]] = [(0, None)] * (n + 1)
        best[0] = (0, 0, 0)
        for i in range(n):
            here = best[i]
            if here is None:
                continue
            for end, value, is_known, missing in sorted(pieces.get(i, ()), key=lambda x: (x[0], x[3], not x[2])):
                cost = (here[0] + missing, here[1] + (not is_known), here[2] + (value is not None))
                if best[end] is None or cost < best[end]:
                    best[end], back[end] = cost, (i, value)
            skipped = _is_name(text[i]) or text[i] in "[]\"'`"
            cost = (here[0] + skipped, here[1], here[2])
            if best[i + 1] is None or cost < best[i + 1]:
                best[i + 1], back[i + 1] = cost, (i, None)
        out: list[str] = []
        at = n
        while at:
            at, value = back[at]
            if value is not None:
                out.append(value)
        return out[::-1]


def dictionary(df: DataFrame, fields: list[str]) -> DataFrame:
    """(value) distinct values with a delimiter inside that cleanly written fields hold, in lower case.

    Plain names need no dictionary: the grammar finds them.
    """

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = {_lowered(v) for t in b["text"] for v in (clean_values(t) or ()) if any(not _is_name(c) for c in v)}
            yield pd.DataFrame({"value": pd.Series(sorted(found), dtype=object)})

    texts = df.select(F.explode(F.array(*(F.col(c) for c in fields))).alias("text")).where("text is not null")
    return texts.mapInPandas(values, "value string").distinct()


def split_fields(df: DataFrame, row_id: str, fields: list[str], block_values: int = 200_000) -> DataFrame:
    """(row_id, fieldname, valueposition, columnvalue), positions from 1.

    An automaton holds about ``block_values`` values of the dictionary. Where there are more, one block after another adds
    its hits to the rows, which are written in between, and its values are released before the next is made; so a
    task never has more than one automaton, and the last step chooses among the hits of all.
    """
    id_type = dict(df.dtypes)[row_id]
    known = settle(dictionary(df, fields), "known")
    blocks = max(1, -(-known.count() // block_values))
    each = F.array(*(F.struct(F.lit(f).alias("fieldname"), F.col(f).alias("text")) for f in fields))
    long = df.select(F.col(row_id).alias("id"), F.inline(each)).where("text is not null").withColumn("hits", F.expr("cast(array() as array<int>)"))
    schema = f"id {id_type}, fieldname string, text string, hits array<int>"
    result = f"`{row_id}` {id_type}, fieldname string, valueposition int, columnvalue string"

    def values(i: int) -> Broadcast:
        return df.sparkSession.sparkContext.broadcast([r[0] for r in known.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == i).collect()])

    def splitting(shared: Broadcast | None):  # noqa: ANN202
        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            segmenter = Segmenter([] if shared is None else shared.value)
            for b in batches:
                rows = []
                for key, field, text, h in zip(b["id"], b["fieldname"], b["text"], b["hits"], strict=True):
                    pairs = None if shared is not None else list(zip(map(int, h[::2]), map(int, h[1::2]), strict=True))
                    rows += [(key, field, p, v) for p, v in enumerate(segmenter.split(text, pairs), 1)]
                out = pd.DataFrame(rows, columns=[row_id, "fieldname", "valueposition", "columnvalue"])
                yield out.astype({row_id: b["id"].dtype}) if len(out) else out

        return split

    if blocks == 1:
        return long.mapInPandas(splitting(values(0)), result)
    former = None
    for i in range(blocks):
        shared = values(i)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            segmenter = Segmenter(shared.value)
            for b in batches:
                b["hits"] = [[*h, *(x for pair in segmenter.hits(t) for x in pair)] for h, t in zip(b["hits"], b["text"], strict=True)]
                yield b

        long = settle(long.mapInPandas(find, schema), "hits")
        shared.destroy()
        drop(former)
        former = long
    return long.mapInPandas(splitting(None), result)
