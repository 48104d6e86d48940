"""References to objects in definition texts.

A text is cut into words, commas and opening parentheses once; then each
keyword is looked at with the words after it. With ``compat`` the scan has
the reference's blind spots: what follows a ``from`` list without a word in between isn't
seen as a keyword, ``as`` or a parenthesis ends the list, and of each DDL keyword only
the first counts. Names are taken as they stand; temporary tables, CTE names
and the like come out too and go in the cleanse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.lineage.normalize import plain_space
from loamwork.functions.names import split_name

#: Words that are no alias, words that end a list of tables, and the statements that change objects.
NO_ALIAS = frozenset("WHERE ON SET INNER LEFT RIGHT FULL CROSS JOIN GROUP ORDER HAVING".split())
LIST_END = frozenset("WHERE JOIN INNER LEFT RIGHT FULL CROSS GROUP ORDER HAVING ON SET UNION EXCEPT INTERSECT".split())
DDL = {("CREATE", "ALTER", "DROP"): ("TABLE", "VIEW", "PROCEDURE", "PROC", "FUNCTION"), ("TRUNCATE",): ("TABLE",)}
DDL_WORDS = {(verb, kind): verb for verbs, kinds in DDL.items() for verb in verbs for kind in kinds}
_WORD = re.compile(r"[^ ,(]+|[,(]")


class _Scan:
    def __init__(self, text: str, compat: bool) -> None:
        found = list(_WORD.finditer(text))
        self.words = [m[0] for m in found]
        self.upper = [w.upper() for w in self.words]
        # a keyword has a space on either side
        self.spaced = [m.start() > 0 and text[m.start() - 1] == " " and m.end() < len(text) and text[m.end()] == " " for m in found]
        self.compat = compat
        self.alias: dict[str, str] = {}
        self.out: list[tuple[str, str]] = []

    def at(self, i: int) -> str:
        return self.words[i] if i < len(self.words) and self.words[i] not in (",", "(") else ""

    def emit(self, op: str, name: str) -> None:
        if name and (parts := split_name(name)) and parts[-1]:
            self.out.append((op, name))

    def is_word(self, i: int, *words: str) -> bool:
        return all(i + k < len(self.words) and self.upper[i + k] == w and self.spaced[i + k] for k, w in enumerate(words))

    def aliases(self) -> None:
        """Aliases that follow the first name after ``from`` and ``join``; the last one of a name counts."""
        for i in range(len(self.words)):
            if self.is_word(i, "FROM") or self.is_word(i, "JOIN"):
                k = i + 2
                if self.at(i + 1) and self.at(k).upper() == "AS":
                    k += 1
                if self.at(i + 1) and self.at(k) and self.at(k).upper() not in NO_ALIAS:
                    self.alias[self.at(k).lower()] = self.at(i + 1)

    def past_group(self, i: int) -> int:
        """Index after the parenthesis that opens at i. Closing ones are words of their own after normalising."""
        depth = 0
        while i < len(self.words):
            depth += (self.words[i] == "(") - (self.words[i] == ")")
            i += 1
            if depth <= 0:
                break
        return i

    def from_list(self, i: int) -> int:
        """Names of the list that begins at i; index from where keywords may follow."""
        n = len(self.words)
        while i < n:
            if self.words[i] == ",":  # an empty place
                i += 1
                continue
            if self.words[i] == "(":
                if self.compat:
                    return i
                i = self.past_group(i)
            elif self.upper[i] in LIST_END:
                return i + 1 if self.compat else i
            elif self.words[i] in (")", ";") and not self.compat:
                return i
            else:
                self.emit("SELECT", self.words[i])
                i += 1
                if i < n and self.words[i] == "(":
                    if self.compat:
                        return i
                    i = self.past_group(i)
            if i < n and self.words[i] == ",":
                i += 1
                continue
            if i < n and self.upper[i] == "AS":
                if self.compat:
                    return i + 1
                i += 1
            if i < n and self.upper[i] in LIST_END:
                return i + 1 if self.compat else i
            if i < n and self.words[i] in (")", ";") and not self.compat:
                return i
            if i < n and self.words[i] not in ("(", ","):
                i += 1  # alias
            if i < n and self.words[i] == ",":
                i += 1
                continue
            return i + 1 if self.compat and i < n and self.words[i] != "(" else i
        return i

    def selects(self) -> None:
        i = 0
        while i < len(self.words):
            if self.is_word(i, "FROM"):
                i = self.from_list(i + 1) if self.compat else (self.from_list(i + 1), i + 1)[1]
            elif self.is_word(i, "JOIN"):
                self.emit("SELECT", self.at(i + 1))
                i += 1
            else:
                i += 1

    def run(self) -> list[tuple[str, str]]:
        self.aliases()
        self.selects()
        seen: set[tuple[str, str]] = set()
        resolve = lambda w: self.alias.get(w.lower(), w)
        for i in range(len(self.words)):
            if not self.spaced[i]:
                continue
            w = self.upper[i]
            if w == "INTO":
                before = "".join(f"{x} " for x in self.upper[max(0, i - 10) : i])[:-1][-10:]
                self.emit("INSERT", self.at(i + 1)) if self.is_word(i - 1, "INSERT") or "INSERT" not in before else None
            elif w == "UPDATE":
                self.emit("UPDATE", resolve(self.at(i + 1)))
            elif w == "DELETE":
                self.emit("DELETE", resolve(self.at(i + 2 if self.at(i + 1).upper() == "FROM" else i + 1)))
            elif w == "MERGE":
                k = i + 2 if self.at(i + 1).upper() == "INTO" else i + 1
                self.emit("MERGE", self.at(k))
                using = next((u for u in range(k + 1, len(self.words)) if self.is_word(u, "USING")), None)
                if using is not None:
                    self.emit("SELECT", self.at(using + 1))
            elif w in ("EXEC", "EXECUTE"):
                k = i + 1
                if not self.compat and self.at(k).startswith("@") and self.at(k + 1) == "=":
                    k += 2
                self.emit("EXECUTE", self.at(k))
            elif i + 1 < len(self.words) and self.spaced[i + 1] and (pair := (w, self.upper[i + 1])) in DDL_WORDS:
                if not (self.compat and pair in seen):
                    self.emit(DDL_WORDS[pair], self.at(i + 2))
                seen.add(pair)
        return self.out


def references(text: str | None, compat: bool = False) -> list[tuple[str, str]]:
    """(operation, name) of each reference in a text with plain white space."""
    return _Scan(text, compat).run() if text else []


def parsed_dependencies(definitions: DataFrame, compat: bool = False) -> DataFrame:
    """(source parts, operationtype, target parts): one row a reference; the source is the object whose text it is.

    Missing parts of a name are the source's server and database, and schema dbo.
    A null text gives no rows; equal references repeat.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for server, database, schema, name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for op, ref in references(text, compat):
                    parts = split_name(ref)
                    four = [None] * (4 - len(parts)) + parts
                    rows.append((server, database, schema, name, op, four[0] or server, four[1] or database, four[2] or "dbo", four[3]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], NAMES)

    texts = definitions.where(F.col("objectdefinition").isNotNull()).select("servername", "databasename", "schemaname", "objectname", plain_space("objectdefinition").alias("t"))
    return texts.mapInArrow(parse, ", ".join(f"{n} string" for n in NAMES))


NAMES = ["sourceserver", "sourcedatabase", "sourceschema", "sourceobject", "operationtype", "targetserver", "targetdatabase", "targetschema", "targetobject"]
