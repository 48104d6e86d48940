from loamwork.storage import Parts, Run, settle, shared_dir


def test_tables_lie_in_the_folder_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = settle(spark.range(5), "t")
    assert df._loamwork_path.startswith(shared_dir(spark)) and df.count() == 5


def test_parts_merge_and_go(spark):
    parts = Parts(settle(spark.range(1), "p"), "p", most=3)
    for n in range(1, 8):
        last = settle(spark.range(n, n + 1), "p")
        parts.add(last)
        assert last.count() == 1
    assert sorted(r[0] for r in parts.df().collect()) == list(range(8)) and len(parts.frames) < 3


def test_runs_join_without_moving(spark):
    a, b = (Run(spark.range(n).selectExpr("id as k", "id % 7 as v"), "k", 4) for n in (100, 60))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = a.df().join(b.df().withColumnRenamed("v", "w"), "k")
        assert both.count() == 60
        assert "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    a.drop(), b.drop()


def test_a_union_of_runs_groups_as_one_table(spark):
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    a, b = (Run(spark.range(100).selectExpr("id % 50 as k", "id as v"), "k", 4) for _ in range(2))
    assert a.df().unionByName(b.df()).groupBy("k").sum("v").count() == 50
    assert a.df().union(b.df()).select("k").distinct().count() == 50
    a.drop(), b.drop()
