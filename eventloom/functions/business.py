"""Seconds inside weekly business slots, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY, WEEK = 86_400, 7 * 86_400
#: Monday to Friday, 7 to 17 o'clock, as seconds of the week.
WORKDAYS = tuple((d * DAY + 7 * 3600, d * DAY + 17 * 3600) for d in range(5))


def merged(slots) -> list[tuple[int, int]]:
    """Slots in order, overlapping ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(slots):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def business_seconds(start_us: Column, end_us: Column, slots=WORKDAYS) -> Column:
    """Seconds between two times (microseconds since 1970) that lie in the slots: a difference of two running totals."""
    slots = merged(slots)
    total = sum(b - a for a, b in slots) * 1_000_000

    def until(us: Column) -> Column:
        monday = us + F.lit(3 * DAY * 1_000_000)  # 1970 began on a Thursday
        rest = F.pmod(monday, F.lit(WEEK * 1_000_000))
        weeks = ((monday - rest) / F.lit(WEEK * 1_000_000)).cast("long")
        inside = sum((F.least(F.greatest(rest - F.lit(a * 1_000_000), F.lit(0)), F.lit((b - a) * 1_000_000)) for a, b in slots), F.lit(0))
        return weeks * F.lit(total) + inside

    return (until(end_us) - until(start_us)) / F.lit(1e6)
