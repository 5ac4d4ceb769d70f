"""Value coercions used at ingest and small labels used in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.functions.text import casefold, strip
from jobweave.vocab import FALSE_WORDS, TRUE_WORDS


def parse_date(c: Column) -> Column:
    """ISO date of the first ten characters, else of a full ISO date-time.

    Stricter than a cast: ``2026-6`` is not a date here.
    """
    t = strip(c)
    head = F.substring(t, 1, 10)
    dashed = F.when(
        head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")
    )
    # compact form: exactly eight digits, alone or before a T
    compact = F.when(
        t.rlike(r"^\d{8}($|[T ]\d{2})"), F.try_to_date(F.substring(t, 1, 8), "yyyyMMdd")
    )
    return F.coalesce(dashed, compact, _week_date(t))


def _week_date(t: Column) -> Column:
    """ISO week dates, ``2026-W23-2``, ``2026-W23`` and ``2026W232``; the day is Monday
    when it is left out.  Week 53 only in years that have one."""
    pattern = r"^(\d{4})(-?)W(\d{2})(?:\2([1-7]))?(?:$|[T ]\d{2})"
    part = lambda i: F.regexp_extract(t, pattern, i)
    year, week = part(1).try_cast("int"), part(3).try_cast("int")
    day = F.coalesce(part(4).try_cast("int"), F.lit(1))
    fourth = F.when(t.rlike(pattern) & (year > 0), F.make_date(year, F.lit(1), F.lit(4)))
    monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7)
    return F.when((week >= 1) & (F.year(F.date_add(monday, 3)) == year), F.date_add(monday, day - 1))


def strict_date(c: Column) -> Column:
    """A whole ``yyyy-MM-dd`` text and nothing behind it, else NULL."""
    t = strip(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def parse_list(c: Column) -> Column:
    """Text list split on ``;`` when there is one, else on ``,``."""
    parts = F.when(F.contains(c, F.lit(";")), F.split(c, ";", -1)).otherwise(
        F.split(c, ",", -1)
    )
    return F.coalesce(clean_list(parts), F.array().cast("array<string>"))


def clean_list(values: Column) -> Column:
    return F.filter(F.transform(values, strip), lambda v: v != F.lit(""))


def parse_bool(c: Column) -> Column:
    word = casefold(strip(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(
        word.isin(*FALSE_WORDS), F.lit(False)
    )


def opt_label(flag: Column) -> Column:
    return (
        F.when(flag, F.lit("cpt_opt_friendly"))
        .when(~flag, F.lit("not_cpt_opt_friendly"))
        .otherwise(F.lit("unknown"))
    )


def week_bucket(day: Column) -> Column:
    """Monday of the week as ISO text, ``unknown`` without a date."""
    return F.coalesce(
        F.date_format(F.date_trunc("week", day), "yyyy-MM-dd"), F.lit("unknown")
    )

