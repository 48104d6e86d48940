import datetime as dt

from pyspark.sql import functions as F

from loamwork.operators.column_profile import column_profile
from loamwork.operators.date_dimension import date_dimension
from loamwork.operators.dimension_queries import orders_by_fiscal_quarter
from loamwork.operators.text_chunks import text_chunks
from loamwork.operators.time_dimension import time_dimension, time_key

TODAY = dt.date(2024, 6, 15)


def test_fiscal_attributes_and_business_days(spark):
    holidays = spark.createDataFrame([(20240614, "A", 1), (20240614, "A", 1), (20240618, "B", 0)], "DimDate_SK int, PublicHolidayType string, CountBusinessDays int")
    dates = date_dimension(spark, TODAY, dt.date(2024, 6, 1), dt.date(2024, 7, 1), holidays=holidays)
    by = {r.DimDate_SK: r for r in dates.collect()}
    assert len(by) == 31 + 1 + 2
    june = by[20240630]
    assert (june.FiscalYear, june.FiscalQuarter, june.FiscalHalf, june.FiscalYearStart, june.FiscalHalfStart) == (2024, 4, 2, dt.date(2023, 7, 1), dt.date(2024, 1, 1))
    assert (by[20240701].FiscalYear, by[20240701].RelativeFiscalYear) == (2025, 1)
    days = {k: r.RelativeBusinessDays_Holiday_A for k, r in by.items()}
    assert (days[20240614], days[20240613], days[20240612], days[20240615], days[20240616], days[20240617]) == (0, 0, -1, 0, 0, 1)
    assert by[20240614].Holiday_A == 1 and by[20240618].Holiday_B == 1 and by[-1].Holiday_A == 0
    assert "RelativeBusinessDays_Holiday_B" not in dates.columns
    assert (by[-1].Date, by[-1].MonthName, by[-1].MonthStart) == (dt.date(1, 1, 1), "NA", None)


def test_fiscal_to_date_flags_on_the_first_day(spark):
    dates = date_dimension(spark, dt.date(2024, 7, 1), dt.date(2024, 1, 1), dt.date(2024, 12, 30), sentinels=False)
    assert dates.agg(F.min("IsFiscalYTDToday"), F.count("*")).first() == (1, 366)
    dates = date_dimension(spark, dt.date(2024, 7, 2), dt.date(2024, 1, 1), dt.date(2024, 12, 31), sentinels=False, inclusive_only=True)
    assert dates.agg(F.max("IsFiscalYTDYesterday"), F.count("*")).first() == (0, 366)


def test_default_range_and_one_day(spark):
    assert date_dimension(spark, TODAY).count() == 109_576
    assert date_dimension(spark, TODAY, TODAY, TODAY, inclusive_only=True, sentinels=False).count() == 1


def test_orders_of_any_date_or_none_are_counted(spark, rows, tmp_path):
    days = [dt.datetime(1985, 1, 1, 8), dt.datetime(1700, 6, 30), dt.datetime(2150, 7, 1), dt.datetime(9999, 12, 31), dt.datetime(2000, 1, 1), dt.datetime(2000, 2, 1), None]
    spark.createDataFrame([(n, day, 1.5) for n, day in enumerate(days)], "o_orderkey long, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(orders_by_fiscal_quarter(spark, str(tmp_path))) == sorted([(1985, 3, 1, 1.5), (1700, 4, 1, 1.5), (2151, 1, 1, 1.5), (10000, 2, 1, 1.5), (2000, 3, 2, 3.0), (None, None, 1, 1.5)], key=repr)


def test_time_dimension(spark):
    times = {r.DimTime_SK: r for r in time_dimension(spark).where("DimTime_SK in (-1, 1, 47108)").collect()}
    t = times[47108]
    assert (t.Time, t.Hour24, t.Hour12, t.AMPM, t.Interval24_5Min, t.Interval24_QuarterHour, t.Interval12_5Min, t.Interval12_Second) == ("13:05:07", 13, 1, "PM", "13:05:00", "13:00:00", "01:05:00", "13:05:07")
    assert (times[1].Hour12, times[1].Interval12_Hour, times[-1].AMPM) == (12, "12:00:00", "NA")
    keys = spark.createDataFrame([(dt.datetime(2024, 1, 1, 13, 5, 7),), (None,)], "t timestamp").select(time_key(F.col("t"))).collect()
    assert [k[0] for k in keys] == [47108, -1]


def test_column_profile(spark):
    df = spark.createDataFrame([("b", 1.0, True, [1]), ("a ", 10.0, None, None), (None, 2.0, True, None), ("b", None, False, None), ("a ", 2.0, True, None), ("c", 10.0, True, None)], "s string, x double, f boolean, skipped array<int>")
    p = {r.ColumnName: r for r in column_profile(df, lengths={"s": 1}).collect()}
    s = p["s"]
    assert (s.TotalRows, s.DistinctValues, s.UniqueValues, s.NullValues, s.MostCommonValue, s.MostCommonValueAppears, s.MinimumLength, s.MaxLength, s.MaxLengthReached) == (6, 3, 2, 1, "a, b", 2, 1, 1, 1)
    assert (p["x"].MostCommonValue, p["x"].MinValue, p["x"].MaxLengthReached, p["f"].MinValue, p["f"].MaxValue) == ("2.0, 10.0", "1.0", None, "0", "1")
    assert set(p) == {"s", "x", "f"}


def test_column_profile_of_an_empty_table_and_many_ties(spark):
    empty = column_profile(spark.createDataFrame([], "a int")).first()
    assert (empty.TotalRows, empty.NullPercentage, empty.MostCommonValue, empty.DistinctValues) == (0, None, None, 0)
    many = column_profile(spark.createDataFrame([(n,) for n in range(12)] + [(None,)], "a int")).first()
    assert many.MostCommonValue == "Limit (10) Reached: <NULL>, 0, 1, 2, 3, 4, 5, 6, 7, 8"


def test_text_chunks(spark, rows):
    df = spark.createDataFrame([(1, "abcdefg", 0), (2, "   ", 0), (3, None, 0), (4, "abc", 0)], "k int, t string, chunk_no int")
    assert rows(text_chunks(df.select("k", "t"), ["k"], "t", 3)) == [(1, 1, "abc"), (1, 2, "def"), (1, 3, "g"), (2, 1, "No content to print"), (3, 1, "No content to print"), (4, 1, "abc")]
    assert rows(text_chunks(df.limit(0), ["k"], "t")) == []
