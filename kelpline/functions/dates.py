"""Column functions on dates. Months are counted by the boundaries crossed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import MONTH_NAMES


def month_index(c: Column) -> Column:
    """Months since year 0, so that neighbours differ by one."""
    return F.year(c) * 12 + F.month(c) - 1


def months_between(start: Column, end: Column) -> Column:
    """Month boundaries from ``start`` to ``end``; the days in the month don't count."""
    return month_index(end) - month_index(start)


def month_start(c: Column) -> Column:
    return F.trunc(c, "MM")


def month_series(first: Column, last: Column) -> Column:
    """All month starts from ``first`` to ``last``; empty if they are reversed."""
    empty = F.array().cast("array<date>")
    return F.when(first <= last, F.sequence(first, F.greatest(first, last), F.expr("interval 1 month"))).otherwise(empty)


def year_quarter(c: Column) -> Column:
    return F.concat(F.year(c), F.lit("-Q"), F.quarter(c))


def long_date(c: Column) -> Column:
    """A date such as ``August 13, 2018``; null for anything else."""
    return F.try_to_date(c, "MMMM d, yyyy")


def banded(value: Column, bands: list[tuple[float, str]]) -> Column:
    """The name of the first band whose upper end is above the value; null beyond the last."""
    out = F.lit(None).cast("string")
    for top, name in reversed(bands):
        out = F.when(value < top, name).otherwise(out)
    return out


def band_place(c: Column, bands: list[tuple[float, str]]) -> Column:
    """The place of a band's name in the bands' order, from 1; null for other names."""
    return F.nullif(F.array_position(F.array(*(F.lit(name) for _, name in bands)), c), F.lit(0)).cast("int")


def month_of_name(c: Column) -> Column:
    """'March 2020', 'sept 2020 ...' as '2020-03'; null where the text doesn't begin with a month's name and a year."""
    names = F.create_map(*(F.lit(x) for k, m in enumerate(MONTH_NAMES, 1) for form in m for x in (form, f"{k:02}")))
    pattern = r"^([a-zA-Z]+)\s+(\d{4})"
    text = F.regexp_replace(c, r"^\s+", "")
    month = F.try_element_at(names, F.lower(F.regexp_extract(text, pattern, 1)))
    return F.concat(F.regexp_extract(text, pattern, 2), F.lit("-"), month)
