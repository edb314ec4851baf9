"""Date ranges from natural language, Vietnamese first, always relative to an explicit day.

An expression names a calendar unit (day, week, month, quarter, year), which one (an ordinal, a year, this or that one),
and perhaps a part of it (the start, the middle, the end). Two calendars exist side by side: TimeParser's (the start of
a month is its first five days, its end the 21st on; N days ago ends yesterday) and the spoken periods of the entity rules (the
first and last ten days; N days ago ends today), which are also a column expression.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tamarind.functions.reading import Phrases, Question

Range = tuple[date, date]

# Number words (năm also means year, so it counts only before a unit and a direction).
NUMBERS = {"một": 1, "hai": 2, "ba": 3, "bốn": 4, "sáu": 6, "bảy": 7, "tám": 8, "chín": 9, "mười": 10}
# How far words shift a unit, and which weekday they name.
SHIFT = {"nay": 0, "này": 0, "trước": -1, "ngoái": -1, "kia": -2, "sau": 1}
WEEKDAYS = {"hai": 0, "2": 0, "ba": 1, "3": 1, "tư": 2, "bốn": 2, "4": 2, "năm": 3, "5": 3, "sáu": 4, "6": 4, "bảy": 5, "7": 5}
# Words for units.
UNITS = {"hôm": "day", "ngày": "day", "day": "day", "days": "day", "tuần": "week", "tuan": "week", "week": "week", "weeks": "week", "tháng": "month", "thang": "month", "month": "month", "months": "month", "quý": "quarter", "năm": "year", "nam": "year", "year": "year", "years": "year"}
# Words that send N units back or ahead.
PAST = Phrases(("gần đây nhất", "gần nhất", "gần đây", "vừa qua", "qua", "trước", "ngoái", "ago"))
AHEAD = Phrases(("tiếp theo", "tới"))
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def add_months(d: date, n: int) -> date:
    """The same day n months on, or that month's last."""
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, min(d.day, last_day(y, m + 1)))


def last_day(year: int, month: int) -> int:
    return (date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)).day


def unit_range(unit: str, d: date, shift: int = 0) -> Range:
    """The calendar unit that holds d, or the one `shift` units on."""
    if unit == "day":
        return (d + timedelta(shift),) * 2
    if unit == "week":
        first = d - timedelta(d.weekday()) + timedelta(weeks=shift)
        return first, first + timedelta(6)
    n = MONTHS[unit]
    first = add_months(date(d.year, (d.month - 1) // n * n + 1, 1), n * shift)
    return first, add_months(first, n) - timedelta(1)


def days_of(r: Range, first: int, last: int | None = None) -> Range:
    """Days `first` to `last` of a range, from 1; a negative first counts from its end."""
    a = r[1] + timedelta(first + 1) if first < 0 else r[0] + timedelta(first - 1)
    return min(max(a, r[0]), r[1]), r[1] if last is None else min(r[0] + timedelta(last - 1), r[1])


# Spoken periods as (unit, shift, part), in the order in which they are sought.
SPOKEN = {
    "hôm nay": ("day", 0, ""), "hôm qua": ("day", -1, ""), "tuần này": ("week", 0, "to date"), "tuần trước": ("week", -1, ""), "tuần qua": ("week", -1, ""),
    "tháng này": ("month", 0, "to date"), "tháng trước": ("month", -1, ""), "tháng qua": ("month", -1, ""), "tháng rồi": ("month", -1, ""),
    "đầu tháng": ("month", 0, "first ten to date"), "cuối tháng": ("month", 0, "last ten"), "năm nay": ("year", 0, "to date"), "năm ngoái": ("year", -1, ""), "năm trước": ("year", -1, ""), "năm qua": ("year", -1, ""),
    "đầu năm": ("year", 0, "quarter 1"), "cuối năm": ("year", 0, "quarter 4"), **{f"{q}{n}": ("year", 0, f"quarter {k}") for k, ns in enumerate((("1", "một", "i"), ("2", "hai", "ii"), ("3", "ba", "iii"), ("4", "bốn", "iv")), 1) for q, n in (*(("quý ", x) for x in ns), ("q", str(k)))},
    "quý này": ("quarter", 0, ""), "quý trước": ("quarter", -1, ""), "quý qua": ("quarter", -1, ""),
}
_SPOKEN = {p: Phrases((p,)) for p in SPOKEN}


def spoken_part(unit: str, shift: int, part: str, today: date) -> Range:
    r = unit_range(unit, today, shift)
    if part.startswith("quarter"):
        return unit_range("quarter", add_months(r[0], 3 * int(part[-1]) - 3))
    if part == "to date":
        return r[0], today
    if part == "first ten to date":
        return r[0], min(today, r[0] + timedelta(9))
    return days_of(r, -10) if part == "last ten" else r


def spoken_range(q: Question, today: date) -> Range | None:
    """'từ <day> đến <day>'; a day without a year takes the other one's, else this year."""
    for i in range(len(q)):
        if q.low(i) != "từ" or not (a := q.day(i + 1, today.year, bare=True)) or q.low(a[1]) not in ("đến", "tới", "->"):
            continue
        if b := q.day(a[1] + 1, a[0].year, bare=True):
            own_year = any(t.low.isdigit() and len(t.low) == 4 for t in q.tokens[i + 1 : a[1]])
            start = a[0] if own_year else q.day(i + 1, b[0].year, bare=True)[0]
            return start, b[0]
    return None


def spoken_day(q: Question, today: date) -> date | None:
    return next((d[0] for i in range(len(q)) if (d := q.day(i, today.year))), None)


def spoken_month(q: Question, today: date) -> date | None:
    """The first day of 'tháng 3', 'tháng 3 năm 2025', 'tháng 3/2025', or 2025-03; a year told elsewhere counts too."""
    for i in range(len(q)):
        if q.low(i) == "tháng" and (m := q.number(i + 1, 1, 2)) and 1 <= m[0] <= 12:
            y = next((y for w in ("năm", "/", "-") if (y := q.after(m[1], w))), None) or next((y for k in range(len(q)) if (y := q.after(k, "năm"))), None)
            return date(int(y or today.year), m[0], 1)
        y, m = q.number(i, 4, 4), q.number(i + 2, 2, 2)
        if y and m and q.low(i + 1) == "-" and q.low(i + 3) != "-" and 1 <= m[0] <= 12 and y[0]:
            return date(y[0], m[0], 1)
    return None


def spoken_period(q: Question, today: date) -> Range | None:
    """An explicit range, else N units ago, a named period, a single day, a month, a year."""
    if r := spoken_range(q, today):
        return r
    for i in range(len(q)):
        n, unit = q.number(i, 1, 4), UNITS.get(q.low(i + 1))
        if n and unit in ("day", "week", "month", "year") and (PAST.at(q, i + 2) or q.low(i + 2) in ("gần", "nay")):
            return today - timedelta(n[0] * {"day": 1, "week": 7, "month": 30, "year": 365}[unit]), today
    for name, phrase in _SPOKEN.items():
        if hit := next(phrase.all(q), None):
            unit, shift, part = SPOKEN[name]
            y = q.after(hit[2], "năm") or q.after(hit[2], "/") if part.startswith("quarter") else None
            return spoken_part(unit, shift, part, date(int(y), 1, 1) if y else today)
    if d := spoken_day(q, today):
        return d, d
    if m := spoken_month(q, today):
        return unit_range("month", m)
    y = next((y for i in range(len(q)) if (y := q.after(i, "năm"))), None)
    return unit_range("year", date(int(y), 1, 1)) if y else None


class TimeParser:
    """Expressions to closed ranges of days; None where there is none."""

    def __init__(self, as_of: date):
        self.today = as_of

    def parse(self, text: str | None) -> Range | None:
        """An explicit range, else so many units back or ahead, an open range ('từ X'), or the first expression."""
        if not text or not text.strip():
            return None
        q = Question(text.lower())
        return self._last_days(q) or self._explicit(q) or self._relative(q, 0, len(q)) or self._open(q) or self._first(q, 0, len(q))

    def _first(self, q: Question, a: int, z: int) -> Range | None:
        return next((r for i in range(a, z) if (r := self._expression(q, i))), None)

    def _expression(self, q: Question, i: int) -> Range | None:
        """The expression that begins at token i."""
        w, today = q.low(i), self.today
        if w == "thứ" and q.low(i + 1) in WEEKDAYS or w == "chủ" and q.low(i + 1) == "nhật":
            week = unit_range("week", today, self._shift(q, i + 3) if q.low(i + 2) == "tuần" else 0)
            return days_of(week, k := WEEKDAYS[q.low(i + 1)] + 1 if w == "thứ" else 7, k)
        if w == "hôm" and q.low(i + 1) in ("nay", "qua", "kia"):
            return unit_range("day", today, -("nay", "qua", "kia").index(q.low(i + 1)))
        if w in ("nay", "kia") and len(q) == 1 + (i == 1 and q.low(0) == "ngày") or (w, q.low(i + 1)) in (("hiện", "tại"), ("bây", "giờ")):
            return unit_range("day", today, -2 if w == "kia" else 0)
        if d := self._day(q, i):
            return d, d
        if w == "trong" and q.low(i + 1) == "ngày" and not q.low(i + 2).isdigit():
            return today, today
        if w == "trong" and q.low(i + 1) == "năm" and not q.low(i + 2).isdigit() and q.low(i + 2) not in ("ngoái", "trước", "sau", "kia"):
            return unit_range("year", today)[0], today
        if len(q) == 1 and (y := q.number(0, 4, 4)):
            return unit_range("year", date(y[0], 1, 1))
        part, j = (w, i + 1) if w in ("đầu", "giữa", "cuối") else (f"{w} {q.low(i + 1)}", i + 2) if w == "nửa" and q.low(i + 1) in ("đầu", "cuối", "sau") else ("", i)
        reader = {"tuần": self._week, "tháng": self._month, "quý": self._quarter, "năm": self._year_unit}.get(q.low(j))
        return reader(q, j + 1, part) if reader else None

    def _shift(self, q: Question, i: int) -> int:
        return SHIFT.get(q.low(i), 0) if q.low(i) != "kia" else 0

    def _year(self, q: Question, i: int, word: bool = True) -> tuple[int, int] | None:
        """(year, place after it) of '[năm] 2024', 'năm ngoái'; with `word` năm has to be there."""
        j = q.skip(i, "năm")
        if word and j == i:
            return None
        if n := q.number(j, 4, 4):
            return n
        return (self.today.year + SHIFT[q.low(j)], j + 1) if q.low(j) in SHIFT else None

    def _day(self, q: Question, i: int) -> date | None:
        if q.low(i) == "ngày" and (d := q.number(i + 1, 1, 2)) and q.low(d[1]) == "tháng" and (m := q.number(d[1] + 1, 1, 2)):
            y = self._year(q, m[1])
            return _make(y[0] if y else self.today.year, m[0], d[0])
        if d := q.day(i, self.today.year):
            return d[0]
        d, m, y = q.number(i, 1, 2), q.number(i + 2, 1, 2), q.number(i + 4, 2, 2)
        return _make(2000 + y[0], m[0], d[0]) if d and m and y and q.low(i + 1) == q.low(i + 3) and q.low(i + 1) in ("/", "-") else None

    def _week(self, q: Question, i: int, part: str) -> Range:
        week = unit_range("week", self.today, self._shift(q, i))
        if part == "cuối":  # the coming one, on a Sunday the next
            d = self.today + timedelta(weeks=self._shift(q, i))
            saturday = d + timedelta((5 - d.weekday()) % 7)
            return saturday, saturday + timedelta(1)
        return days_of(week, 1, 1) if part == "đầu" else week

    def _month(self, q: Question, i: int, part: str) -> Range | None:
        if q.low(i) == "trong" and (y := self._year(q, i + 1)):
            return unit_range("year", date(y[0], 1, 1))
        m = q.number(i, 1, 2)
        if m and 1 <= m[0] <= 12:
            back = q.number(m[1], 1, 3)
            short = q.number(m[1] + 1, 2, 4) if q.low(m[1]) in ("/", "-") else None
            if back and q.low(back[1]) == "năm" and q.low(back[1] + 1) == "trước":
                year = self.today.year - back[0]
            else:
                year = short[0] + (2000 if short[0] < 100 else 0) if short else (self._year(q, m[1]) or (self.today.year,))[0]
            month = unit_range("month", date(year, m[0], 1))
        elif q.low(i)[:1].isdigit() or q.low(i) == "trong":
            return None
        else:
            month = unit_range("month", self.today, self._shift(q, i))
        days = {"đầu": (1, 5), "giữa": (11, 20), "cuối": (21,), "nửa đầu": (1, 15), "nửa cuối": (16,), "nửa sau": (16,)}.get(part)
        return days_of(month, *days) if days else month

    def _quarter(self, q: Question, i: int, part: str) -> Range:
        n = q.number(i, 1, 1)
        if n and 1 <= n[0] <= 4:
            year = (self._year(q, n[1], word=False) or (self.today.year,))[0]
            if part in ("đầu", "giữa", "cuối"):
                return unit_range("month", date(year, 3 * n[0] - 2 + ("đầu", "giữa", "cuối").index(part), 1))
            return unit_range("quarter", date(year, 3 * n[0], 1))
        r = unit_range("quarter", self.today, self._shift(q, i))
        if part == "đầu":
            days = q.number(q.skip(q.skip(i, *SHIFT), "trong"), 1, 2)
            return days_of(r, 1, days[0] if days else 10)
        return (r[0], min(r[1], self.today)) if q.low(i) in ("này", "nay") else r

    def _year_unit(self, q: Question, i: int, part: str) -> Range | None:
        y = self._year(q, i, word=False)
        if not y and not part:
            return None
        r = unit_range("year", date(y[0] if y else self.today.year, 1, 1))
        if part == "đầu":
            return days_of(r, 1, 10)
        if part == "giữa":
            return unit_range("month", date(r[0].year, 6, 1))
        # The end of a year told in digits is the whole of it.
        return days_of(r, -11) if part == "cuối" and not q.low(i).isdigit() else r

    def _relative(self, q: Question, a: int, z: int) -> Range | None:
        """[N] units back or ahead, where nothing names a part, a weekday or a day of a month with its year."""
        if any(q.low(i) in ("thứ", "đầu", "cuối", "giữa") or (q.low(i), q.low(i + 1)) == ("chủ", "nhật") or self._day(q, i) and q.low(i) == "ngày" for i in range(a, z)):
            return None
        for i in range(a, z):
            unit = UNITS.get(q.low(i))
            back, ahead = PAST.at(q, i + 1), AHEAD.at(q, i + 1)
            if unit in (None, "quarter") or not (back or ahead):
                continue
            if q.low(i - 3) == "tháng" and q.low(i - 2).isdigit() and q.low(i - 1).isdigit():
                return None  # that month, so many years ago
            before = q.low(i - 1) if i > a else ""
            n = int(before) if before.isdigit() else NUMBERS.get(before, 5 if before == "năm" else 1)
            if ahead:
                return self.today, {"day": self.today + timedelta(n), "week": self.today + timedelta(weeks=n)}.get(unit) or add_months(self.today, n * MONTHS[unit])
            if unit == "day":
                return self.today - timedelta(n), self.today - timedelta(1)
            if unit == "week":
                return self.today - timedelta(weeks=n), self.today
            first = unit_range(unit, self.today, -n)
            return (first[0], unit_range(unit, self.today, -1)[1]) if unit == "month" else first
        return None

    def _explicit(self, q: Question) -> Range | None:
        """'[từ] A đến B'; a start without a year takes the end's if it would lie after it."""
        links = [i for i in range(1, len(q)) if q.low(i) in ("đến", "tới", "->", "~") or q.low(i) == "-" and not q.glued(i) and not q.glued(i + 1)]
        if links:
            left = (0, links[0] - (q.low(links[0] - 1) == "cho")), (links[-1] + 1, len(q))
        else:  # two dates side by side
            at = [i for i in range(len(q)) if (d := q.day(i, self.today.year)) and q.low(i) != "ngày" and not q.glued(i)]
            if len(at) < 2:
                return None
            left = (0, at[1]), (at[1], len(q))
        a, b = (self._first(q, *side) or self._relative(q, *side) for side in left)
        if not a or not b:
            return None
        start, end = a[0], b[1]
        if start > end and not any(q.low(i).isdigit() and len(q.low(i)) == 4 for i in range(*left[0])):
            start = _make(end.year, start.month, start.day) or date(end.year, start.month, 28)
        return start, end

    def _open(self, q: Question) -> Range | None:
        r = self._first(q, 1, len(q)) if q.low(0) == "từ" else None
        return (r[0], self.today) if r else None

    def _last_days(self, q: Question) -> Range | None:
        """'từ ngày cuối [cùng] của tháng [trước] về N ngày': the last N days of a month."""
        for i in range(len(q)):
            if q.low(i) == "cuối" and q.low(i - 1) == "ngày":
                j = q.skip(q.skip(i + 1, "cùng"), "của")
                n = next((n[0] for k in range(j + 1, len(q)) if (n := q.number(k, 1, 2)) and q.low(n[1]) == "ngày"), None)
                if q.low(j) == "tháng" and n:
                    return days_of(unit_range("month", self.today, self._shift(q, j + 1)), -n)
        return None


def _make(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def time_range(text: Column, as_of: Column | date) -> Column:
    """struct<start:date,end:date> of a time expression, null where no rule holds."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)

    @pandas_udf("start date, end date")
    def run(t: pd.Series, d: pd.Series) -> pd.DataFrame:
        memo: dict = {}
        out = []
        for x, y in zip(t, d):
            if (x, y) not in memo:
                parsers = memo.setdefault(("p", y), TimeParser(y)) if y is not None else None
                memo[(x, y)] = (parsers.parse(x) if parsers else None) or (None, None)
            out.append(memo[(x, y)])
        return pd.DataFrame(out, columns=["start", "end"])

    return run(text, day)


def named_period(text: Column, as_of: Column) -> Column:
    """struct<start:date,end:date> of the spoken period named in a text, all in the JVM; null if none is named. A phrase counts as whole words."""
    t, d = F.lower(text), as_of
    add = lambda unit, x, n: F.date_add(x, 7 * n) if unit == "week" else F.date_add(x, n) if unit == "day" else F.add_months(x, MONTHS[unit] * n)
    out = None
    for name, (unit, shift, part) in SPOKEN.items():
        first = add(unit, F.date_trunc(unit, d).cast("date"), shift)
        last = F.date_sub(add(unit, first, 1), 1)
        if part.startswith("quarter"):
            first = F.add_months(first, 3 * int(part[-1]) - 3)
            last = F.date_sub(F.add_months(first, 3), 1)
        elif part:
            first, last = {"to date": (first, d), "first ten to date": (first, F.least(d, F.date_add(first, 9))), "last ten": (F.date_sub(last, 9), last)}[part]
        there = t.rlike(rf"(?U)(?<!\w){re.escape(name).replace(chr(92) + ' ', chr(92) + 's+')}(?!\w)")
        r = F.struct(first.cast("date").alias("start"), last.cast("date").alias("end"))
        out = F.when(there, r) if out is None else out.when(there, r)
    return out


def working_days(start: Column, end: Column) -> Column:
    """Days from Monday to Friday in a closed range, 0 for a reversed one; by arithmetic, so that long ranges cost nothing."""
    n = F.datediff(end, start) + 1
    first = F.weekday(start)
    rest = n % 7
    # Of the days beyond whole weeks, those that fall on a weekend.
    off = F.greatest(F.lit(0), F.least(first + rest, F.lit(7)) - F.greatest(first, F.lit(5))) + F.greatest(F.lit(0), F.least(first + rest, F.lit(14)) - F.lit(12))
    return F.when(n > 0, (n - rest) / 7 * 5 + rest - off).when(n <= 0, F.lit(0)).cast("int")


def iso_date(x: Column) -> Column:
    """dd/mm/yyyy or dd-mm-yyyy as an ISO date string; other text stays as it is."""
    p = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4})\s*$"
    part = lambda i: F.regexp_extract(x, p, i)
    return F.when(x.rlike(p), F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))).otherwise(x)
