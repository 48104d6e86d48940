"""Queries over the dimensions, the column profile and text pieces, and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators.column_profile import column_profile
from loamwork.operators.date_dimension import DATES, TEXTS, date_dimension
from loamwork.operators.text_chunks import text_chunks
from loamwork.operators.time_dimension import BUCKETS, time_dimension, time_key
from loamwork.sources.tables import table

TODAY, FIRST, LAST = dt.date(2000, 6, 15), dt.date(1990, 1, 1), dt.date(2030, 12, 31)
#: Sample of public holidays: (key, type, name, substitute, counted).
HOLIDAYS = [
    (20000101, "North", "New Year's Day", 0, 1),
    (20000103, "North", "New Year's Day", 1, 1),
    (20000605, "North", "Foundation Day", 0, 1),
    (20000619, "North", "Midwinter", 0, 1),
    (20000619, "North", "Midwinter", 1, 1),
    (20001225, "North", "Christmas Day", 0, 1),
    (20000614, "South", "Harbour Day", 0, 1),
    (20000616, "South", "Harbour Day", 1, 1),
    (20000704, "East Side", "Fair", 0, 0),
]
HOLIDAY_SCHEMA = "DimDate_SK int, PublicHolidayType string, PublicHolidayName string, PublicHolidaySubstitute int, CountBusinessDays int"
#: Sample of declared lengths, some of which the data reach.
LENGTHS = {"o_orderstatus": 1, "o_orderpriority": 30, "c_mktsegment": 10, "p_brand": 40, "r_name": 11, "n_name": 25, "referenced_schema_name": 6, "referencedobjecttype": 60}
CALENDAR = ["DimDate_SK", "Date", "CalendarYear", "Month", "Day", *TEXTS, "CalendarQuarter", "CalendarHalf", *DATES[:5], "UnixStartOfDay", "UnixEndOfDay"]
FISCAL = ["DimDate_SK", "FiscalYear", "FiscalHalf", "FiscalQuarter", "FiscalYearStart", "FiscalHalfStart"]


def _dates(spark: SparkSession) -> DataFrame:
    return date_dimension(spark, TODAY, FIRST, LAST)


def date_dim_calendar(spark: SparkSession, d: str) -> DataFrame:
    return _dates(spark).select(*CALENDAR)


def date_dim_fiscal(spark: SparkSession, d: str) -> DataFrame:
    return _dates(spark).select(*FISCAL)


def date_dim_relative(spark: SparkSession, d: str) -> DataFrame:
    x = _dates(spark)
    return x.select("DimDate_SK", *(c for c in x.columns if c.startswith("Relative")))


def date_dim_flags(spark: SparkSession, d: str) -> DataFrame:
    x = _dates(spark)
    return x.select("DimDate_SK", *(c for c in x.columns if c.lower().startswith("is")))


def _holiday_dates(spark: SparkSession) -> DataFrame:
    return date_dimension(spark, TODAY, FIRST, LAST, holidays=spark.createDataFrame(HOLIDAYS, HOLIDAY_SCHEMA))


def date_dim_holidays(spark: SparkSession, d: str) -> DataFrame:
    x = _holiday_dates(spark)
    return x.select("DimDate_SK", *(c for c in x.columns if c.startswith("Holiday_")))


def date_dim_business_days(spark: SparkSession, d: str) -> DataFrame:
    x = _holiday_dates(spark)
    return x.select("DimDate_SK", *(c for c in x.columns if c.startswith("RelativeBusinessDays_")))


def orders_by_fiscal_quarter(spark: SparkSession, d: str) -> DataFrame:
    # orders are reduced to one row a day before the join
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("Date")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    # the dimension spans the orders, and orders without a date stay
    span = days.agg(F.min("Date"), F.max("Date")).first()
    dates = date_dimension(spark, TODAY, min(span[0] or FIRST, FIRST), max(span[1] or LAST, LAST), inclusive_only=True, sentinels=False)
    return days.join(dates.select("Date", "FiscalYear", "FiscalQuarter"), "Date", "left").groupBy("FiscalYear", "FiscalQuarter").agg(F.sum("n").alias("orders"), F.sum("total").cast("double").alias("total_price"))


def time_dim(spark: SparkSession, d: str) -> DataFrame:
    return time_dimension(spark)


def events_by_quarter_hour(spark: SparkSession, d: str) -> DataFrame:
    times = time_dimension(spark).select("DimTime_SK", "Interval24_QuarterHour")
    seconds = table(spark, d, "events").groupBy(time_key(F.col("ts")).alias("DimTime_SK"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return seconds.join(times, "DimTime_SK").groupBy("Interval24_QuarterHour", "event_type").agg(F.sum("n").alias("events"))


def _profile(name: str):  # noqa: ANN202
    def query(spark: SparkSession, d: str) -> DataFrame:
        p = column_profile(table(spark, d, name), "sales", "dbo", name, LENGTHS)
        rounded = [c for c in p.columns if c.endswith("Percentage")]
        return p.withColumns({c: F.round(c, 6) for c in rounded} | {"AverageLength": F.col("AverageLength").cast("double")})

    query.__name__ = f"profile_{name}"
    return query


def longprint_documents(spark: SparkSession, d: str) -> DataFrame:
    return text_chunks(table(spark, d, "documents"), ["doc_id"], "text")


def longprint_small_pieces(spark: SparkSession, d: str) -> DataFrame:
    return text_chunks(table(spark, d, "documents"), ["doc_id"], "text", 500).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.max(F.length("chunk")).alias("longest"))


PROFILES = ["orders", "customer", "part", "region", "nation", "lng_objectexpressiondependency"]
QUERIES = {
    f.__name__: f
    for f in (
        date_dim_calendar, date_dim_fiscal, date_dim_relative, date_dim_flags, date_dim_holidays, date_dim_business_days, orders_by_fiscal_quarter,
        time_dim, events_by_quarter_hour, *map(_profile, PROFILES), longprint_documents, longprint_small_pieces,
    )
}

_SPINE = f"s AS (SELECT CAST(range AS DATE) AS d FROM range(DATE '{FIRST}', DATE '{LAST + dt.timedelta(days=2)}', INTERVAL 1 DAY))"
_T = f"DATE '{TODAY}'"
_Y = f"DATE '{TODAY - dt.timedelta(days=1)}'"
_I = lambda x: f"CAST({x} AS INTEGER)"
_MMDD = lambda x: f"strftime({x}, '%m%d')"
_FY = lambda x: f"(year({x}) + CASE WHEN {_MMDD(x)} >= '0701' THEN 1 ELSE 0 END)"
_FH = lambda x: f"(CASE WHEN (month({x}) + 5) % 12 < 6 THEN 1 ELSE 2 END)"
_FQ = lambda x: f"(((month({x}) + 5) % 12) // 3 + 1)"
_HALF = lambda x: f"(CASE WHEN month({x}) <= 6 THEN 1 ELSE 2 END)"
_MON = lambda x: f"({x} - CAST(isodow({x}) - 1 AS INTEGER))"
_SUN = lambda x: f"({x} - CAST(dayofweek({x}) AS INTEGER))"
_FYS = "make_date(CAST(" + _FY("d") + " - 1 AS INTEGER), 7, 1)"
_DATE_SQL = {
    "DimDate_SK": _I("strftime(d, '%Y%m%d')"), "Date": "d", "CalendarYear": _I("year(d)"), "Month": _I("month(d)"), "Day": _I("day(d)"),
    "MonthName": "monthname(d)", "MonthShortName": "monthname(d)[:3]", "MonthAndCalendarYear": "monthname(d)[:3] || ' ' || year(d)", "DayName": "dayname(d)",
    "CalendarQuarter": _I("quarter(d)"), "CalendarHalf": _HALF("d"), "MonthStart": "CAST(date_trunc('month', d) AS DATE)", "CalendarQuarterStart": "CAST(date_trunc('quarter', d) AS DATE)",
    "CalendarHalfStart": "make_date(CAST(year(d) AS INTEGER), CASE WHEN month(d) <= 6 THEN 1 ELSE 7 END, 1)", "WeekStartMonday": _MON("d"), "WeekStartSunday": _SUN("d"),
    "UnixStartOfDay": "CAST(epoch(d) AS BIGINT)", "UnixEndOfDay": "CAST(epoch(d) AS BIGINT) + 86399",
    "FiscalYear": _I(_FY("d")), "FiscalHalf": _FH("d"), "FiscalQuarter": _I(_FQ("d")), "FiscalYearStart": _FYS, "FiscalHalfStart": f"CAST({_FYS} + to_months(6 * ({_FH('d')} - 1)) AS DATE)",
    "RelativeCalendarYear": _I(f"year(d) - year({_T})"), "RelativeMonth": _I(f"(year(d) - year({_T})) * 12 + month(d) - month({_T})"), "RelativeDay": _I(f"d - {_T}"),
    "RelativeCalendarQuarter": _I(f"(year(d) - year({_T})) * 4 + quarter(d) - quarter({_T})"), "RelativeCalendarHalf": _I(f"(year(d) - year({_T})) * 2 + {_HALF('d')} - {_HALF(_T)}"),
    "RelativeFiscalYear": _I(f"{_FY('d')} - {_FY(_T)}"), "RelativeFiscalHalf": _I(f"({_FY('d')} - {_FY(_T)}) * 2 + {_FH('d')} - {_FH(_T)}"), "RelativeFiscalQuarter": _I(f"({_FY('d')} - {_FY(_T)}) * 4 + {_FQ('d')} - {_FQ(_T)}"),
    "RelativeWeekStartMonday": _I(f"({_MON('d')} - {_MON(_T)}) // 7"), "RelativeWeekStartSunday": _I(f"({_SUN('d')} - {_SUN(_T)}) // 7"),
    "isEndOfMonth": _I("last_day(d) = d"), "IsWeekday": _I("isodow(d) < 6"), "IsWeekend": _I("isodow(d) >= 6"),
    "IsMTDToday": _I(f"day(d) <= day({_T})"), "IsMTDYesterday": _I(f"day(d) <= day({_Y})"), "IsYTDToday": _I(f"{_MMDD('d')} <= {_MMDD(_T)}"), "IsYTDYesterday": _I(f"{_MMDD('d')} <= {_MMDD(_Y)}"),
    "IsFiscalYTDToday": _I(f"{_MMDD('d')} >= '0701' OR {_MMDD('d')} <= {_MMDD(_T)}"), "IsFiscalYTDYesterday": _I(f"{_MMDD('d')} >= '0701' OR {_MMDD('d')} <= {_MMDD(_Y)}"),
}


def _dates_sql(columns: list[str]) -> str:
    fixed = lambda sk, day: {"DimDate_SK": sk, "Date": f"DATE '{day}'", **{c: "'NA'" for c in TEXTS}, **{c: "CAST(NULL AS DATE)" for c in DATES}}
    rows = [f"SELECT {', '.join(f'{f.get(c, 0)} AS {c}' for c in columns)}" for f in (fixed("-1", "0001-01-01"), fixed("99991231", "9999-12-31"))]
    return f"WITH {_SPINE} SELECT {', '.join(f'{_DATE_SQL[c]} AS {c}' for c in columns)} FROM s UNION ALL {' UNION ALL '.join(rows)}"


_HOLIDAY_VALUES = ", ".join(f"({sk}, '{t}')" for sk, t, *_ in HOLIDAYS)
_HOLIDAY_SQL = f"h AS (SELECT DISTINCT sk, kind FROM (VALUES {_HOLIDAY_VALUES}) v(sk, kind)), b AS ({_dates_sql(['DimDate_SK', 'Date', 'IsWeekend'])})"
_FLAG = lambda t: f"CASE WHEN b.DimDate_SK IN (SELECT sk FROM h WHERE kind = '{t}') THEN 1 ELSE 0 END"
_BUSINESS = lambda t: f"""
CAST(CASE WHEN b.Date < {_T} THEN -(SELECT count(*) FROM b x WHERE x.Date > b.Date AND x.Date < {_T} AND x.IsWeekend = 0 AND x.DimDate_SK NOT IN (SELECT sk FROM h WHERE kind = '{t}'))
 WHEN b.Date > {_T} THEN (SELECT count(*) FROM b x WHERE x.Date > {_T} AND x.Date <= b.Date AND x.IsWeekend = 0 AND x.DimDate_SK NOT IN (SELECT sk FROM h WHERE kind = '{t}')) ELSE 0 END AS INTEGER)"""  # noqa: E731

_C2 = lambda h, m, s: f"lpad(CAST({h} AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} AS VARCHAR), 2, '0')"
_H, _H12 = "(i // 3600)", "(CASE WHEN (i // 3600) % 12 = 0 THEN 12 ELSE (i // 3600) % 12 END)"
_B = lambda n, h: _C2(h, f"(((i - i % {n}) // 60) % 60)", f"((i - i % {n}) % 60)")
_TIME_SQL = {
    "DimTime_SK": "i + 1", "Time": _B(1, _H), "Second": _I("i % 60"), "Minute": _I("(i // 60) % 60"), "Hour24": _I(_H), "Hour12": _I(_H12), "AMPM": "CASE WHEN i < 43200 THEN 'AM' ELSE 'PM' END",
    **{f"Interval24_{b}": _B(n, _H) for b, n in BUCKETS.items()}, **{f"Interval12_{b}": _B(n, _H if b == "Second" else _H12) for b, n in BUCKETS.items()},
}
_ZERO = {"DimTime_SK": "-1", "AMPM": "'NA'", **{c: "0" for c in ("Second", "Minute", "Hour24", "Hour12")}}

_COLUMNS = {
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "lng_objectexpressiondependency": {
        "expressiondependencyid": "bigint", "referencingobjectid": "int", "referencingserver": "string", "referencingdatabase": "string", "referencingschema": "string", "referencingobject": "string",
        "referencingobjecttype": "string", "referenced_id": "int", "referenced_server_name": "string", "referenced_database_name": "string", "referenced_schema_name": "string",
        "referenced_entity_name": "string", "referencedobjecttype": "string", "is_ambiguous": "int", "capturedate": "timestamp",
    },
}


def _profile_sql(name: str) -> str:
    selects = []
    for n, (c, t) in enumerate(_COLUMNS[name].items(), 1):
        shown = {"timestamp": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "string": "rtrim({0}, ' ')"}.get(t, "CAST({0} AS VARCHAR)")
        size = f"length(rtrim({c}, ' '))"
        lengths = f"min({size})::INTEGER AS MinimumLength, round(avg({size}), 2)::DOUBLE AS AverageLength, max({size})::INTEGER AS MaxLength" if t == "string" else "NULL::INTEGER AS MinimumLength, NULL::DOUBLE AS AverageLength, NULL::INTEGER AS MaxLength"
        declared = LENGTHS.get(c, "NULL")
        reached = f"(coalesce(MaxLength, 0) >= {declared})" if c in LENGTHS else "NULL"
        order = "v" if t == "string" or t == "timestamp" else "CAST(v AS DOUBLE)"
        selects.append(f"""
SELECT {n}::INTEGER AS ColumnNumber, 'sales' AS DatabaseName, 'dbo' AS SchemaName, {declared}::INTEGER AS Length, NULL::INTEGER AS "Precision", NULL::INTEGER AS Scale, {reached}::INTEGER AS MaxLengthReached, '{name}' AS TableName, '{c}' AS ColumnName, '{t if t != "timestamp" else "timestamp_ntz"}' AS Type, a.*, m.MostCommonValue, g.top AS MostCommonValueAppears, round(g.top * 100.0 / TotalRows, 6)::DOUBLE AS MostCommonValuePercentage,
  g.DistinctValues, g.UniqueValues, round(g.UniqueValues * 100.0 / TotalRows, 6)::DOUBLE AS UniquenessPercentage, g.NullValues, round(g.NullValues * 100.0 / TotalRows, 6)::DOUBLE AS NullPercentage
FROM (SELECT count(*) AS TotalRows, {shown.format(f'min({c})')} AS MinValue, {shown.format(f'max({c})')} AS MaxValue, {lengths} FROM {name}) a,
 (SELECT max(k) AS top, count(v) AS DistinctValues, count(*) FILTER (WHERE k = 1) AS UniqueValues, coalesce(max(k) FILTER (WHERE v IS NULL), 0)::BIGINT AS NullValues FROM (SELECT {shown.format(c)} AS v, count(*) AS k FROM {name} GROUP BY 1)) g,
 (SELECT CASE WHEN count(*) = 10 THEN 'Limit (10) Reached: ' ELSE '' END || string_agg(coalesce(v, '<NULL>'), ', ' ORDER BY r) AS MostCommonValue FROM
   (SELECT v, row_number() OVER (ORDER BY {order} NULLS FIRST) AS r FROM (SELECT {shown.format(c)} AS v, count(*) AS k FROM {name} GROUP BY 1 QUALIFY rank() OVER (ORDER BY k DESC) = 1)) WHERE r <= 10) m""")
    return " UNION ALL ".join(selects)


SQL = {
    "date_dim_calendar": _dates_sql(CALENDAR),
    "date_dim_fiscal": _dates_sql(FISCAL),
    "date_dim_relative": _dates_sql(["DimDate_SK", *(c for c in _DATE_SQL if c.startswith("Relative"))]),
    "date_dim_flags": _dates_sql(["DimDate_SK", *(c for c in _DATE_SQL if c.lower().startswith("is"))]),
    "date_dim_holidays": f"WITH {_HOLIDAY_SQL} SELECT DimDate_SK, {_FLAG('East Side')} AS Holiday_East_Side, {_FLAG('North')} AS Holiday_North, {_FLAG('South')} AS Holiday_South FROM b",
    "date_dim_business_days": f"WITH {_HOLIDAY_SQL} SELECT DimDate_SK, {_BUSINESS('North')} AS RelativeBusinessDays_Holiday_North, {_BUSINESS('South')} AS RelativeBusinessDays_Holiday_South FROM b",
    "orders_by_fiscal_quarter": f"WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders) SELECT {_I(_FY('d'))} AS FiscalYear, {_I(_FQ('d'))} AS FiscalQuarter, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price FROM x GROUP BY ALL",
    "time_dim": f"SELECT {', '.join(f'{e} AS {c}' for c, e in _TIME_SQL.items())} FROM (SELECT range AS i FROM range(86400)) UNION ALL SELECT {', '.join(f'''{_ZERO.get(c, "'00:00:00'")} AS {c}''' for c in _TIME_SQL)}",
    "events_by_quarter_hour": "SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%H:%M:%S') AS Interval24_QuarterHour, event_type, count(*) AS events FROM events GROUP BY ALL",
    **{f"profile_{t}": _profile_sql(t) for t in PROFILES},
    "longprint_documents": "SELECT doc_id, n::INTEGER AS chunk_no, CASE WHEN coalesce(length(rtrim(text, ' ')), 0) = 0 THEN 'No content to print' ELSE substring(text, (n - 1) * 8000 + 1, 8000) END AS chunk FROM documents, range(1, 100) r(n) WHERE n <= CASE WHEN coalesce(length(rtrim(text, ' ')), 0) = 0 THEN 1 ELSE ceil(length(text) / 8000) END",
    "longprint_small_pieces": "SELECT doc_id, CASE WHEN coalesce(length(rtrim(text, ' ')), 0) = 0 THEN 1 ELSE CAST(ceil(length(text) / 500) AS BIGINT) END AS pieces, CASE WHEN coalesce(length(rtrim(text, ' ')), 0) = 0 THEN 19 ELSE CAST(least(length(text), 500) AS INTEGER) END AS longest FROM documents",
}
