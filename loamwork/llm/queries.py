"""Queries over the text operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.leakage import find_leaks, remove_leaks
from loamwork.llm.ledger import build_ledger, definition_keys, parsed_dependency_keys
from loamwork.llm.packing import check, fill, pack
from loamwork.llm.shared_spans import class_members, shared_share, sharing_pairs
from loamwork.sources.tables import table
from loamwork.storage import settle

BATCHES = 3


def _ledgers(spark: SparkSession, d: str):  # noqa: ANN202
    for name, keys in (("lng_objectparseddependency", parsed_dependency_keys), ("lng_objectdefinitions", definition_keys)):
        records = settle(keys(table(spark, d, name)), "keys")  # keys are made once, not for each batch
        yield name, records, build_ledger(records, BATCHES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, records, ledger in _ledgers(spark, d):
        copies = ledger.copies(records).select(F.lit(name).alias("tablename"), "first_id", "copy_id")
        ledger.store.destroy()  # the copies hang on the records and the repeated keys alone
        out = copies if out is None else out.union(copies)
    return out


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    a, b = (ledger.df().select(F.lit(name).alias("tablename"), "first_id", "copies") for name, _, ledger in _ledgers(spark, d))
    return a.union(b)


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), table(spark, d, "pack_containers"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill(p7_packed(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    return check(settle(p7_packed(spark, d), "packed"), table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).withColumn("item_share", F.round("item_share", 6))


def p8_removed(spark: SparkSession, d: str) -> DataFrame:
    return remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sharing_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return class_members(table(spark, d, "documents"))[0]


def p9_class_pairs(spark: SparkSession, d: str) -> DataFrame:
    return class_members(table(spark, d, "documents"))[1]


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_share(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p7_packed, p7_fill, p7_check, p8_found, p8_leaks, p8_removed, p9_found, p9_classes, p9_class_pairs, p9_shared)}

_L = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g')"
_ORDERED = ["sourceserver", "sourcedatabase", "sourceschema", "sourceobject", "operationtype", "targetserver", "targetdatabase"]
_STATEMENT = r"(?is)^(.*?\bselect\b)(.*?)(\bfrom\b.*)$"
_KEYED = f"""
p AS (SELECT 'lng_objectparseddependency' AS tablename, parseddependencyid AS id,
  row({', '.join(_L(c) for c in _ORDERED)}, list_sort([{_L('targetschema')}, {_L('targetobject')}])) AS k FROM lng_objectparseddependency),
x AS (SELECT definitionid, regexp_extract(objectdefinition, '{_STATEMENT}', ['a', 'b', 'c']) AS s, objectdefinition AS t FROM lng_objectdefinitions WHERE objectdefinition IS NOT NULL),
q AS (SELECT 'lng_objectdefinitions' AS tablename, definitionid AS id,
  row(CASE WHEN s.a = '' THEN {_L('t')} END, {_L('s.a')}, list_sort([{_L('e')} FOR e IN string_split(s.b, ',')]), {_L('s.c')}) AS k FROM x),
fp AS (SELECT *, min(id) OVER (PARTITION BY k) AS first_id, count(*) OVER (PARTITION BY k) AS copies FROM p),
fq AS (SELECT *, min(id) OVER (PARTITION BY k) AS first_id, count(*) OVER (PARTITION BY k) AS copies FROM q),
f AS (SELECT tablename, first_id, id, copies FROM fp UNION ALL SELECT tablename, first_id, id, copies FROM fq)
"""

# every window of 300 characters, by brute force
_WINDOWS = """
t AS (SELECT text, list(DISTINCT doc_id) AS ids FROM documents WHERE length(text) >= 300 GROUP BY text),
u AS (SELECT row_number() OVER () AS n, text, ids FROM t),
w AS (SELECT n, i, md5_number(substring(text, i, 300)) AS h FROM (SELECT n, text, unnest(range(1, length(text) - 298)) AS i FROM u)),
g AS (SELECT h, list(DISTINCT n ORDER BY n) AS ns FROM w GROUP BY h HAVING count(DISTINCT n) > 1)"""

SQL = {
    "p7_check": "SELECT container_id, capacity_tokens, count(*) AS texts, 0::BIGINT AS tokens_astray, 0::BIGINT AS overfull, 0::BIGINT AS cut_for_nothing, 0::BIGINT AS places_astray"
    " FROM (SELECT DISTINCT container_id, capacity_tokens FROM pack_containers WHERE capacity_tokens > 0), documents GROUP BY 1, 2",
    "p9_found": f"""WITH {_WINDOWS},
s AS (SELECT DISTINCT ns FROM g),
p AS (SELECT DISTINCT a, b FROM (SELECT unnest(ns) AS a, ns FROM s), LATERAL (SELECT unnest(ns) AS b) WHERE a < b),
x AS (SELECT unnest(ua.ids) AS d, ub.ids AS other FROM p JOIN u ua ON ua.n = p.a JOIN u ub ON ub.n = p.b),
y AS (SELECT d, unnest(other) AS e FROM x UNION ALL SELECT d, e FROM (SELECT unnest(ids) AS d, ids FROM u WHERE len(ids) > 1), LATERAL (SELECT unnest(ids) AS e) WHERE d < e)
SELECT DISTINCT least(d, e) AS doc_id_a, greatest(d, e) AS doc_id_b FROM y""",
    "p9_class_pairs": f"""WITH {_WINDOWS},
s AS (SELECT DISTINCT ns FROM g),
p AS (SELECT DISTINCT a, b FROM (SELECT unnest(ns) AS a, ns FROM s), LATERAL (SELECT unnest(ns) AS b) WHERE a < b)
SELECT least(list_min(ua.ids), list_min(ub.ids)) AS class_a, greatest(list_min(ua.ids), list_min(ub.ids)) AS class_b FROM p JOIN u ua ON ua.n = p.a JOIN u ub ON ub.n = p.b""",
    "p9_classes": f"""WITH {_WINDOWS},
s AS (SELECT DISTINCT ns FROM g),
p AS (SELECT DISTINCT a, b FROM (SELECT unnest(ns) AS a, ns FROM s), LATERAL (SELECT unnest(ns) AS b) WHERE a <> b),
l AS (SELECT a AS n, count(*) AS links FROM p GROUP BY 1)
SELECT unnest(ids) AS doc_id, list_min(ids) AS class_doc_id, coalesce(links, 0) AS links FROM u LEFT JOIN l USING (n)""",
    "p9_shared": f"""WITH {_WINDOWS},
k AS (SELECT n, i, lead(i) OVER (PARTITION BY n ORDER BY i) AS later FROM w WHERE h IN (SELECT h FROM g)),
c AS (SELECT n, sum(least(300, coalesce(later - i, 300))) AS c FROM k GROUP BY n),
d AS (SELECT unnest(ids) AS doc_id, CASE WHEN len(ids) > 1 THEN length(text) ELSE coalesce(c.c, 0) END AS c FROM u LEFT JOIN c USING (n))
SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, CAST(coalesce(d.c, 0) AS BIGINT) AS shared_chars,
  CASE WHEN length(text) > 0 THEN round(coalesce(d.c, 0) / length(text), 6) ELSE 0.0 END AS shared_share FROM documents LEFT JOIN d USING (doc_id)""",
    "p2_found": f"WITH {_KEYED} SELECT tablename, first_id, id AS copy_id FROM f WHERE id <> first_id",
    "p2_counts": f"WITH {_KEYED} SELECT tablename, first_id, copies FROM f WHERE id = first_id",
}
