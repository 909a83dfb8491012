"""Calendar periods as whole numbers: units, multiples of them, anchors and business days.

Every unit numbers its periods without gaps, so a calendar from the first period to the last is a
sequence of numbers, and a period's label is read off its number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of units, days of the week from Monday, and months.
_SECONDS = {"s": 1, "S": 1, "second": 1, "min": 60, "T": 60, "minute": 60, "h": 3600, "H": 3600, "hour": 3600}
_DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: Months of a unit that is made of them.
_LENGTHS = {"M": 1, "MS": 1, "ME": 1, "month": 1, "Q": 3, "QS": 3, "QE": 3, "quarter": 3, "Y": 12, "YS": 12, "YE": 12, "A": 12, "AS": 12, "year": 12}
_EPOCH = "DATE'1970-01-01'"


@dataclass(frozen=True)
class Frequency:
    """A unit of the calendar, a multiple of it, and which end of a period labels it."""

    kind: str  # seconds, days, business, weeks or months
    length: int  # seconds or months of the unit
    multiple: int
    shift: int  # what is added to days or months so that a unit starts at a whole multiple
    at_end: bool  # periods are labelled, and counted from, their ends

    def unit_number(self, stamp: Column) -> Column:
        """Which unit a time lies in."""
        day = F.date_diff(stamp.cast("date"), F.expr(_EPOCH)).cast("long")
        if self.kind == "seconds":
            return F.floor(F.unix_micros(stamp) / F.lit(self.length * 1_000_000))
        if self.kind == "business":
            # 1970-01-01 was a Thursday; a weekend belongs to the Friday before it.
            return F.floor((day + 3) / 7) * 5 + F.least(F.pmod(day + 3, F.lit(7)), F.lit(4))
        if self.kind == "weeks":
            return F.floor((day + self.shift) / 7)
        if self.kind == "months":
            month = (F.year(stamp) * 12 + F.month(stamp) - 1).cast("long")
            return F.floor((month + self.shift) / self.length)
        return day

    def origin(self, first: Column) -> Column:
        """The unit that multiples are counted from, of a group whose first time is given."""
        return self.unit_number(F.date_trunc("day", first) if self.kind == "seconds" else first)

    def period_number(self, unit: Column, origin: Column) -> Column:
        """Which period a unit lies in; with labels at the end the first one is a single unit."""
        if self.multiple == 1:
            return unit.cast("long")
        near = unit - origin
        return (F.ceil(near / self.multiple) if self.at_end else F.floor(near / self.multiple)).cast("long")

    def label(self, number: Column, origin: Column) -> Column:
        """The time that stands for a period."""
        unit = number if self.multiple == 1 else origin + number * self.multiple
        if self.kind == "seconds":
            return F.timestamp_micros((unit * self.length * 1_000_000).cast("long"))
        if self.kind == "months":
            start = unit * self.length - self.shift
            start = start + self.length if self.at_end else start
            date = F.make_date(F.floor(start / 12).cast("int"), (F.pmod(start, F.lit(12)) + 1).cast("int"), F.lit(1))
            date = F.date_sub(date, 1) if self.at_end else date
        else:
            if self.kind == "business":
                days = F.floor(unit / 5) * 7 + F.pmod(unit, F.lit(5)) - 3
            elif self.kind == "weeks":
                days = unit * 7 - self.shift + (6 if self.at_end else 0)
            else:
                days = unit
            date = F.date_add(F.expr(_EPOCH), days.cast("int"))
        return date.cast("timestamp")


def frequency(text: str) -> Frequency:
    """Read a frequency: a multiple, a unit and, after a hyphen, an anchor, as in ``15min``, ``2W-FRI``, ``QS-FEB``.

    Units are s, min (T), h (H), D, B (business days), W, and months, quarters and years. ``MS``,
    ``QS``, ``YS`` and the single letters M, Q and Y label a period by its first day, ``ME``, ``QE``
    and ``YE`` by its last. A week without an anchor runs from Monday and is labelled by it; with
    one it ends on that day and is labelled by it. Quarters and years take a month: the one that
    starts them, or the one that ends them if they are labelled by their end.
    """
    found = re.fullmatch(r"(\d*)([A-Za-z]+?)(?:-([A-Z]{3}))?", text)
    if not found or (found[1] and int(found[1]) < 1):
        raise ValueError(f"unknown frequency '{text}'")
    multiple, unit, anchor = int(found[1] or 1), found[2], found[3]
    if unit in _SECONDS and not anchor:
        return Frequency("seconds", _SECONDS[unit], multiple, 0, False)
    if unit in ("D", "day", "B") and not anchor:
        return Frequency("business" if unit == "B" else "days", 1, multiple, 0, False)
    if unit in ("W", "week") and (anchor is None or anchor in _DAYS):
        # Thursday, 1970-01-01, is the fourth day of a week that starts on Monday.
        shift = 3 if anchor is None else (3 - _DAYS.index(anchor) - 1) % 7
        return Frequency("weeks", 7, multiple, shift, anchor is not None)
    if unit in _LENGTHS and (anchor is None or (anchor in _MONTHS and _LENGTHS[unit] > 1)):
        at_end, length = unit in ("ME", "QE", "YE"), _LENGTHS[unit]
        first = _MONTHS.index(anchor) + (1 if at_end else 0) if anchor else 0
        return Frequency("months", length, multiple, -first % length, at_end)
    raise ValueError(f"unknown frequency '{text}'")
