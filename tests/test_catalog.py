from loamwork.lineage.catalog import object_definitions, spark_inventory, spark_view_texts


def test_inventory_of_several_databases(spark):
    spark.sql("create database if not exists inv_a")
    spark.sql("create database if not exists inv_b")
    spark.sql("create table inv_a.sales using parquet as select 1 as n")
    spark.sql("create view inv_a.v_sales as select n from inv_a.sales")
    spark.sql("create function inv_b.plus_one(x int) returns int return x + 1")
    spark.range(1).createOrReplaceTempView("passing")
    try:
        found, failed = spark_inventory(spark, "S", ["inv_a", "no_such_database", "inv_b"])
        rows = sorted((r.databasename, r.objectname, r.objecttype) for r in found.collect())
        assert rows == [("inv_a", "sales", "U"), ("inv_a", "v_sales", "V"), ("inv_b", "plus_one", "FN")]
        assert list(failed) == ["no_such_database"] and failed["no_such_database"]
        texts, unshown = spark_view_texts(spark, found)
        defined = object_definitions(found, texts).collect()
        assert unshown == {} and [r.objectname for r in defined] == ["v_sales"] and "inv_a.sales" in defined[0].objectdefinition
        spark.sql("drop view inv_a.v_sales")
        texts, unshown = spark_view_texts(spark, found)
        assert texts.count() == 0 and list(unshown) == ["`inv_a`.`v_sales`"]
        assert spark_inventory(spark, "S", [])[0].count() == 0
    finally:
        spark.catalog.dropTempView("passing")
        for d in ("inv_a", "inv_b"):
            spark.sql(f"drop database {d} cascade")
