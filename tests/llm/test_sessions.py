"""Ledger and span index absorbed by three applications, one after another, against one pass."""

import os
import subprocess
import sys

from loamwork.llm.ledger import Ledger, build_ledger
from loamwork.llm.shared_spans import SpanIndex, found_spans
from tests.llm.test_shared_spans import docs, sample

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SESSION = """
import sys
from pyspark.sql import SparkSession
from loamwork.llm.ledger import Ledger
from loamwork.llm.shared_spans import SpanIndex
from tests.llm.test_sessions import records
from tests.llm.test_shared_spans import docs, sample
folder, n = sys.argv[1], int(sys.argv[2])
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", str(2 + n)).config("spark.ui.enabled", "false").config("spark.checkpoint.dir", folder + "/shared").config("spark.sql.warehouse.dir", folder + "/warehouse").getOrCreate()
Ledger(spark, 3, folder + "/ledger").absorb(records(spark).where(f"id % 3 = {n}"), f"b{n}")
spans = SpanIndex(spark, buckets=3, hot=2, path=folder + "/spans").absorb(docs(spark, sample(7)).selectExpr("doc_id as doc", "text").where(f"doc % 3 = {n}"), batch_id=f"b{n}")
spans.write.mode("append").parquet(folder + "/found")
spark.stop()
"""


def records(spark):
    return spark.range(600).selectExpr("cast(concat('k', id % 70) as binary) as key", "id")


def test_three_applications_and_one_pass(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for n in range(3):
        subprocess.run([sys.executable, "-c", SESSION, folder, str(n)], cwd=ROOT, check=True, timeout=300, env=os.environ | {"PYTHONPATH": ROOT})
    ledger, index = Ledger(spark, None, f"{folder}/ledger"), SpanIndex(spark, path=f"{folder}/spans")
    assert ledger.store.batches == index.store.batches == ["b0", "b1", "b2"]
    same = lambda x: sorted((bytes(r.key), r.first_id, r.copies) for r in x.df().collect())
    assert same(ledger) == same(build_ledger(records(spark), 1, 3)) and len(same(ledger)) == 70
    found = {tuple(r) for r in spark.read.parquet(f"{folder}/found").collect()}
    assert found == {tuple(r) for r in found_spans(docs(spark, sample(7)))[1].collect()} and found
    # a fourth batch goes on from there
    more = [(500, "new " * 60 + sample(7)[3][1])]
    assert {r.size for r in index.absorb(docs(spark, more).selectExpr("doc_id as doc", "text")).collect()} >= {len(sample(7)[3][1])}
