"""Dates of mixed precision and instants.  `today` and `now` are always arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"


def date_precision(c: Column) -> Column:
    """year, month or day; the first of January stands for its year."""
    s = F.trim(c)
    return F.when(s.rlike("^[0-9]{4}-01-01$"), "year").when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "day").when(s.rlike("^[0-9]{4}-[0-9]{2}$"), "month").when(s.rlike("^[0-9]{4}$"), "year")


def date_to_ms(c: Column, precision: Column | None = None) -> Column:
    """Milliseconds of a day's start, a month's 15th or a year's first of July, in UTC; null for what is no date."""
    s, p = F.trim(c), precision if precision is not None else date_precision(c)
    day = F.when(p == "day", F.substring(s, 1, 10)).when(p == "month", F.concat(F.substring(s, 1, 7), F.lit("-15"))).when(p == "year", F.concat(F.substring(s, 1, 4), F.lit("-07-01")))
    return F.datediff(F.try_to_date(day, "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000


def best_pub_date(online: Column, print_: Column, issued: Column) -> Column:
    """struct<value, precision, kind, ms>: an online day, else a print day, print, online, or whatever there is."""
    one = lambda c, kind: F.when(c != "", F.struct(c.alias("value"), date_precision(c).alias("precision"), F.lit(kind).alias("kind"), date_to_ms(c).alias("ms")))
    o, p, i = one(online, "online"), one(print_, "print"), one(issued, "issued")
    return F.coalesce(F.when(date_precision(online) == "day", o), F.when(date_precision(print_) == "day", p), p, o, i)


def date_from_parts(parts: Column) -> Column:
    """An ISO date of [year, month?, day?], cut where a part is missing or impossible."""
    y, m, d = (F.get(parts, i).cast("int") for i in range(3))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    month = F.when(m.between(1, 12), F.concat(F.lit("-"), two(m), F.when(d.between(1, 31), F.concat(F.lit("-"), two(d))).otherwise("")))
    return F.when(y.isNotNull(), F.concat(F.lpad(y.cast("string"), 4, "0"), F.coalesce(month, F.lit(""))))


def is_date_only(c: Column) -> Column:
    return c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def is_naive(c: Column) -> Column:
    return c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$")


def parse_instant(c: Column) -> Column:
    """A timestamp; values without an offset are UTC (the session's zone is to be UTC)."""
    return F.try_to_timestamp(F.when(is_naive(c), F.concat(F.replace(c, F.lit("T"), F.lit(" ")), F.lit("+00:00"))).otherwise(c))


def to_iso_utc(c: Column) -> Column:
    return F.date_format(parse_instant(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def next_run_at(now: Column, hour: int, minute: int, zone: str = ZONE) -> Column:
    """The next instant after `now` at which clocks in `zone` show the given time."""
    local = F.from_utc_timestamp(now, zone)
    at = F.date_trunc("day", local) + F.make_interval(hours=F.lit(hour), mins=F.lit(minute))
    return F.to_utc_timestamp(F.when(at > local, at).otherwise(at + F.expr("INTERVAL 1 DAY")), zone)


def freshness_score(online: Column, today: str) -> Column:
    """By the age in days of an online date that has a day; .2 without one, .3 for a coarser one, .2 for the future."""
    age = F.datediff(F.lit(today).cast("date"), F.try_to_date(F.trim(online), "yyyy-MM-dd"))
    by_age = F.when(age < 0, 0.2).when(age <= 7, 1.0).when(age <= 30, 0.85).when(age <= 90, 0.6).when(age <= 365, 0.35).otherwise(0.15)
    p = date_precision(online)
    return F.when(p.isNull(), 0.2).when(p != "day", 0.3).otherwise(by_age)


def freshness_order(value: Column, today: str) -> Column:
    """The same for ordering lists: steps at 3, 10, 30, 60 and 120 days, scaled by precision."""
    p = date_precision(value)
    age = (F.lit(today).cast("date").cast("timestamp").cast("long") * 1000 - date_to_ms(value)) / 86_400_000
    base = F.when(age <= 3, 1.0).when(age <= 10, 0.85).when(age <= 30, 0.65).when(age <= 60, 0.4).when(age <= 120, 0.2).otherwise(0.05)
    return F.when(p.isNull(), 0.15).otherwise(base * F.when(p == "day", 1.0).when(p == "month", 0.85).otherwise(0.6))


def window_key(c: Column) -> Column:
    """A day for a date of any precision: the end of its period."""
    return F.when(F.length(c) == 7, F.concat(c, F.lit("-28"))).when(F.length(c) == 4, F.concat(c, F.lit("-12-31"))).otherwise(c)
