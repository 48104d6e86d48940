import pytest

from loamwork.storage import RunStore, publish_text, shared_dir


def frame(spark, a, b):
    return spark.range(a, b).selectExpr("id as k")


def union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def test_runs_are_compacted_and_found_again(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = RunStore(spark, path, {"buckets": 2})
    for n in range(5):
        store.add("x", frame(spark, n * 10, n * 10 + 10), "k", 2)
        store.compact("x", 2, union)
        store.publish(f"b{n}")
    assert [t for _, t, _ in store.runs] == [2, 0] and store.written > 0
    store.close()
    again = RunStore(spark, path, {"buckets": 7})
    assert again.settings == {"buckets": 2} and again.batches == [f"b{n}" for n in range(5)] and again.version == 5
    assert sorted(r[0] for run in again.of("x") for r in run.df().collect()) == list(range(50))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = again.of("x")[0].df().join(again.of("x")[1].df(), "k")
        assert "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    again.close()


def test_what_was_not_published_goes(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = RunStore(spark, path, {})
    store.add("x", frame(spark, 0, 5), "k", 2)
    store.publish()
    store.add("x", frame(spark, 5, 9), "k", 2)
    store.close()
    again = RunStore(spark, path, {})
    assert [r.df().count() for r in again.of("x")] == [5]
    assert len(list((tmp_path / "store" / "runs").iterdir())) == 1


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    one, two = RunStore(spark, path, {}), RunStore(spark, path, {})
    one.publish("a")
    with pytest.raises(FileExistsError):
        two.publish("b")


def test_text_is_never_replaced(spark):
    path = f"{shared_dir(spark)}/told-once"
    publish_text(spark, path, "é")
    with pytest.raises(FileExistsError):
        publish_text(spark, path, "b")
    assert spark.read.text(path).first()[0] == "é"
