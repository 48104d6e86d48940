"""Definition texts without comments and with plain white space."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"'(?:[^']|'')*'?|\"(?:[^\"]|\"\")*\"?|\[(?:[^\]]|\]\])*\]?|--[^\r\n]*|/\*", re.S)
_NEST = re.compile(r"/\*|\*/")


def without_comments(text: str | None) -> str | None:
    """A text without line comments and nested block comments; strings and quoted names stay.

    A block becomes one space, an open block runs to the end.
    """
    if text is None:
        return None
    out, at = [], 0
    while m := _MARK.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0].startswith("--"):
            continue
        if m[0] != "/*":
            out.append(m[0])
            continue
        depth = 1
        while depth:
            n = _NEST.search(text, at)
            if n is None:
                at = len(text)
                break
            depth += 1 if n[0] == "/*" else -1
            at = n.end()
        out.append(" ")
    return "".join([*out, text[at:]])


def remove_comments(df: DataFrame, column: str = "objectdefinition") -> DataFrame:
    """``df`` with the comments taken out of a text column; other columns pass through."""
    place = df.columns.index(column)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = list(b.columns)
            arrays[place] = pa.array([without_comments(t) for t in arrays[place].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, b.schema.names)

    return df.mapInArrow(strip, df.schema)


def plain_space(c: Column | str) -> Column:
    """Text with single spaces, and a space before ``;``, ``)`` and ``,``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"([;),])", r" $1"), r"[ \t\r\n]+", " "))
