"""Dates written in queries, and calendar checks as expressions."""

from __future__ import annotations

import calendar
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and the forms they take after a day.
MONTHS = (
    ("january", "jan", "січень", "січня", "январь", "января"), ("february", "feb", "лютий", "лютого", "февраль", "февраля"),
    ("march", "mar", "березень", "березня", "март", "марта"), ("april", "apr", "квітень", "квітня", "апрель", "апреля"),
    ("may", "травень", "травня", "май", "мая"), ("june", "jun", "червень", "червня", "июнь", "июня"),
    ("july", "jul", "липень", "липня", "июль", "июля"), ("august", "aug", "серпень", "серпня", "август", "августа"),
    ("september", "sep", "sept", "вересень", "вересня", "сентябрь", "сентября"), ("october", "oct", "жовтень", "жовтня", "октябрь", "октября"),
    ("november", "nov", "листопад", "листопада", "ноябрь", "ноября"), ("december", "dec", "грудень", "грудня", "декабрь", "декабря"),
)
BY_NAME = {name: k + 1 for k, names in enumerate(MONTHS) for name in names}


class QueryDate(NamedTuple):
    year: int | None
    month: int
    day: int

    @property
    def valid(self) -> bool:
        # without a year, 29 February is a day
        return 1 <= self.month <= 12 and 1 <= self.day <= calendar.monthrange(self.year or 2024, self.month)[1]


_FORMS = re.compile(
    r"(?<![\w.-])(?:(?P<iso>\d{4}-\d{2}-\d{2})|(?P<dot>\d{2}\.\d{2}(?:\.\d{4})?)|(?P<d1>\d{1,2})\s+(?P<m1>[^\W\d_]+)\.?(?:\s+(?P<y1>\d{4}))?|(?P<m2>[^\W\d_]+)\.?\s+(?P<d2>\d{1,2})(?:,?\s+(?P<y2>\d{4}))?)(?![\w-]|\.\d)"
)


def query_dates(query: str) -> list[QueryDate]:
    """Days that a query names, in order: 2024-05-03, 03.05[.2024], 3 May [2024], May 3 [2024]."""
    out: list[QueryDate] = []
    at = 0
    while m := _FORMS.search(query, at):
        at = m.end()
        if m["iso"]:
            y, mo, d = map(int, m["iso"].split("-"))
        elif m["dot"]:
            d, mo, *rest = map(int, m["dot"].split("."))
            y = rest[0] if rest else None
        else:
            name, day, year = (m["m1"], m["d1"], m["y1"]) if m["d1"] else (m["m2"], m["d2"], m["y2"])
            mo, d, y = BY_NAME.get(name.lower(), 0), int(day), int(year) if year else None
            if not mo:
                at = m.start() + (len(m["d1"]) if m["d1"] else len(m["m2"]))
                continue
        found = QueryDate(y, mo, d)
        if found.valid and found not in out:
            out.append(found)
    return out


def dated_on(updated: Column, dates: list[QueryDate]) -> Column:
    """Whether a date column falls on one of the days; days without a year fall in every year."""
    out = F.lit(False)
    for d in dates:
        hit = (F.month(updated) == d.month) & (F.dayofmonth(updated) == d.day)
        out = out | (hit & (F.year(updated) == d.year) if d.year else hit)
    return F.coalesce(out, F.lit(False))


def leading_date(c: Column) -> Column:
    """A valid YYYY-MM-DD that opens a string and no digit follows, else null."""
    found = F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2})(?!\d)", 1)
    return F.when(F.try_to_timestamp(found, F.lit("yyyy-MM-dd")).isNotNull(), found)
