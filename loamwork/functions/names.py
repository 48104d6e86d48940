"""Names of database objects: parts, keys for comparison, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key(c: Column | str) -> Column:
    """Form in which names compare: no outer spaces, lower case."""
    return F.lower(F.trim(col(c)))


def full_key(*parts: Column | str) -> Column:
    """Dotted name of all parts in comparable form; null if a part is null."""
    dotted: list[Column] = []
    for p in parts:
        dotted += [F.lit("."), key(p)]
    return F.concat(*dotted[1:])


_PART = re.compile(r"\[((?:[^\]]|\]\])*)\]|\"((?:[^\"]|\"\")*)\"|([^.\[\]\"]*)")


def split_name(name: str | None) -> list[str | None] | None:
    """Parts of a dotted name, left to right, without quoting marks.

    ``None`` if it has more than four parts or can't be read; an empty part is ``None``.
    """
    if name is None:
        return None
    parts: list[str | None] = []
    at = 0
    while True:
        m = _PART.match(name, at)
        if m[1] is not None:
            part = m[1].replace("]]", "]")
        elif m[2] is not None:
            part = m[2].replace('""', '"')
        else:
            part = m[3].strip()
        parts.append(part or None)
        at = m.end()
        if at == len(name):
            return parts if len(parts) <= 4 else None
        if name[at] != ".":
            return None
        at += 1


def name_part(name: str | None, number: int) -> str | None:
    """Part counted from the right: 1 object, 2 schema, 3 database, 4 server."""
    parts = split_name(name)
    return parts[-number] if parts and number <= len(parts) else None


def like_regex(pattern: Column | str) -> Column:
    """Regular expression of a column of LIKE patterns, for ``rlike`` on lower-case text.

    ``%`` and ``_`` are wildcards, ``[...]`` a class of characters; there is no escape.
    """
    c = F.lower(col(pattern))
    c = F.regexp_replace(c, r"([\\.^$|?*+(){}])", r"\\$1")
    c = F.regexp_replace(c, r"\[\\\^", "[^")
    c = F.regexp_replace(c, r"%(?![^\[]*\])", ".*")
    c = F.regexp_replace(c, r"_(?![^\[]*\])", ".")
    c = F.regexp_replace(c, r"\[(?![^\[]*\])", r"\\[")
    return F.concat(F.lit("(?s)^"), c, F.lit("$"))


def quoted(name: str) -> str:
    """A name between brackets, as it can stand in a dotted name."""
    return f"[{name.replace(']', ']]')}]"
