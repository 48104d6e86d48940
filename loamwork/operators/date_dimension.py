"""Date dimension: calendar and fiscal attributes, offsets to today, holidays, business days.

One projection over a generated sequence of dates; business days are a running
sum. ``today`` is a parameter, so a dimension can be made again.

Kept from the reference behaviour, as documented in the README: the rows run
one day past ``maximum``; fiscal halves and quarters follow the month alone; the
fiscal to-date flags of a day that is the first of the fiscal year hold for
every row (today) or none (yesterday); the last business day before today has
offset 0, the next one 1, and the sentinel 9999-12-31 counts as a weekday.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SENTINELS = ((-1, dt.date(1, 1, 1)), (99991231, dt.date(9999, 12, 31)))
TEXTS = ("MonthName", "MonthShortName", "MonthAndCalendarYear", "DayName")
DATES = ("MonthStart", "CalendarQuarterStart", "CalendarHalfStart", "WeekStartMonday", "WeekStartSunday", "FiscalYearStart", "FiscalHalfStart")


def _flag(c: Column) -> Column:
    return c.cast("int")


def _attributes(d: Column, today: Column, fiscal_start: str) -> dict[str, Column]:
    fiscal_month, fiscal_day = int(fiscal_start[:2]), int(fiscal_start[2:])
    yesterday = F.date_sub(today, 1)
    mmdd = lambda x: F.date_format(x, "MMdd")
    half = lambda x: F.when(F.month(x) <= 6, 1).otherwise(2)
    fiscal_year = lambda x: F.year(x) + (mmdd(x) >= fiscal_start).cast("int")
    into = lambda x: (F.month(x) - fiscal_month + 12) % 12
    fiscal_half = lambda x: F.when(into(x) < 6, 1).otherwise(2)
    fiscal_quarter = lambda x: F.floor(into(x) / 3).cast("int") + 1
    fiscal_first = F.make_date(fiscal_year(d) - 1, F.lit(fiscal_month), F.lit(fiscal_day))
    monday = lambda x: F.trunc(x, "week")
    sunday = lambda x: F.date_sub(x, F.dayofweek(x) - 1)
    weekend = F.dayofweek(d).isin(1, 7)

    def fiscal_to_date(day: Column, at_start: int) -> Column:
        end = mmdd(day)
        since, until = mmdd(d) >= fiscal_start, mmdd(d) <= end
        return F.when(end == fiscal_start, at_start).when(end > fiscal_start, _flag(since & until)).otherwise(_flag(since | until))

    return {
        "DimDate_SK": mmdd(d).cast("int") + F.year(d) * 10000,
        "Date": d,
        "CalendarYear": F.year(d),
        "Month": F.month(d),
        "Day": F.dayofmonth(d),
        "MonthName": F.date_format(d, "MMMM"),
        "MonthShortName": F.substring(F.date_format(d, "MMMM"), 1, 3),
        "MonthAndCalendarYear": F.concat_ws(" ", F.substring(F.date_format(d, "MMMM"), 1, 3), F.year(d)),
        "DayName": F.date_format(d, "EEEE"),
        "CalendarQuarter": F.quarter(d),
        "CalendarHalf": half(d),
        "MonthStart": F.trunc(d, "month"),
        "CalendarQuarterStart": F.trunc(d, "quarter"),
        "CalendarHalfStart": F.make_date(F.year(d), F.when(F.month(d) <= 6, 1).otherwise(7), F.lit(1)),
        "WeekStartMonday": monday(d),
        "WeekStartSunday": sunday(d),
        "UnixStartOfDay": F.unix_date(d).cast("long") * 86400,
        "UnixEndOfDay": F.unix_date(d).cast("long") * 86400 + 86399,
        "FiscalYear": fiscal_year(d),
        "FiscalHalf": fiscal_half(d),
        "FiscalQuarter": fiscal_quarter(d),
        "FiscalYearStart": fiscal_first,
        "FiscalHalfStart": F.when(fiscal_half(d) == 1, fiscal_first).otherwise(F.add_months(fiscal_first, 6)),
        "RelativeCalendarYear": F.year(d) - F.year(today),
        "RelativeMonth": (F.year(d) - F.year(today)) * 12 + F.month(d) - F.month(today),
        "RelativeDay": F.date_diff(d, today),
        "RelativeCalendarQuarter": (F.year(d) - F.year(today)) * 4 + F.quarter(d) - F.quarter(today),
        "RelativeCalendarHalf": (F.year(d) - F.year(today)) * 2 + half(d) - half(today),
        "RelativeFiscalYear": fiscal_year(d) - fiscal_year(today),
        "RelativeFiscalHalf": (fiscal_year(d) - fiscal_year(today)) * 2 + fiscal_half(d) - fiscal_half(today),
        "RelativeFiscalQuarter": (fiscal_year(d) - fiscal_year(today)) * 4 + fiscal_quarter(d) - fiscal_quarter(today),
        "RelativeWeekStartMonday": (F.date_diff(monday(d), monday(today)) / 7).cast("int"),
        "RelativeWeekStartSunday": (F.date_diff(sunday(d), sunday(today)) / 7).cast("int"),
        "isEndOfMonth": _flag(F.last_day(d) == d),
        "IsWeekday": _flag(~weekend),
        "IsWeekend": _flag(weekend),
        "IsMTDToday": _flag(F.dayofmonth(d) <= F.dayofmonth(today)),
        "IsMTDYesterday": _flag(F.dayofmonth(d) <= F.dayofmonth(yesterday)),
        "IsYTDToday": _flag(mmdd(d) <= mmdd(today)),
        "IsYTDYesterday": _flag(mmdd(d) <= mmdd(yesterday)),
        "IsFiscalYTDToday": fiscal_to_date(today, 1),
        "IsFiscalYTDYesterday": fiscal_to_date(yesterday, 0),
    }


def holiday_types(holidays: DataFrame) -> dict[str, bool]:
    """Each type of holiday, and whether business days are counted for it; types are few and name columns."""
    rows = holidays.groupBy("PublicHolidayType").agg(F.max("CountBusinessDays").alias("counted")).where("PublicHolidayType is not null").collect()
    return {r[0]: bool(r[1]) for r in sorted(rows)}


def holiday_column(kind: str) -> str:
    return "Holiday_" + re.sub(r"\W", "_", kind)


def date_dimension(
    spark: SparkSession,
    today: dt.date,
    minimum: dt.date = dt.date(1800, 1, 1),
    maximum: dt.date = dt.date(2099, 12, 31),
    fiscal_start: str = "0701",
    holidays: DataFrame | None = None,
    inclusive_only: bool = False,
    sentinels: bool = True,
) -> DataFrame:
    """The date dimension, two sentinel rows included.

    ``holidays`` (DimDate_SK, PublicHolidayType, CountBusinessDays, ...) adds a
    ``Holiday_<type>`` column for each type and, where business days are
    counted, ``RelativeBusinessDays_Holiday_<type>``. ``inclusive_only`` ends at ``maximum``.
    """
    last = maximum if inclusive_only else maximum + dt.timedelta(days=1)
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(minimum), F.lit(last))).alias("d"))
    columns = _attributes(F.col("d"), F.lit(today), fiscal_start)
    out = spine.select(*(c.alias(n) for n, c in columns.items()))
    if sentinels:
        kinds = dict(out.dtypes)
        for sk, day in SENTINELS:
            fixed = {"DimDate_SK": F.lit(sk), "Date": F.lit(day.isoformat()).cast("date"), **{n: F.lit("NA") for n in TEXTS}, **{n: F.lit(None) for n in DATES}}
            row = spark.range(1).select(*(fixed.get(n, F.lit(0)).cast(kinds[n]).alias(n) for n in columns))
            out = out.unionByName(row)
    if holidays is None:
        return out
    types = holiday_types(holidays)
    flags = holidays.groupBy(F.col("DimDate_SK").alias("sk")).agg(*(F.max((F.col("PublicHolidayType") == t).cast("int")).alias(holiday_column(t)) for t in types))
    out = out.join(flags, out.DimDate_SK == flags.sk, "left").drop("sk").withColumns({holiday_column(t): F.coalesce(holiday_column(t), F.lit(0)) for t in types})
    return business_days(out, today, [holiday_column(t) for t, counted in types.items() if counted])


def business_days(dates: DataFrame, today: dt.date, holidays: list[str]) -> DataFrame:
    """Add ``RelativeBusinessDays_<holiday>`` for each column: weekdays that are no holidays between each row and today.

    One window pass holds the running sums of all columns and the sums up to today. The
    dimension's size is the calendar's, not the data's, so one task sorts it.
    """
    w = Window.orderBy("Date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    now = F.lit(today)
    added = {}
    for h in holidays:
        counts = _flag((F.col("IsWeekend") == 0) & (F.col(h) == 0))
        upto = lambda bound, n=counts: F.coalesce(F.sum(F.when(bound, n)).over(whole), F.lit(0))
        running = F.sum(counts).over(w)
        value = F.when(F.col("Date") < now, running - upto(F.col("Date") < now)).when(F.col("Date") > now, running - upto(F.col("Date") <= now)).otherwise(0)
        added[f"RelativeBusinessDays_{h}"] = value.cast("int")
    return dates.withColumns(added) if added else dates
