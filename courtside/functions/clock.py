"""Game clocks, dates and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(text: Column) -> Column:
    """``"MM:SS"`` to seconds; NULL when malformed."""
    parts = F.split(text, ":")
    minute = F.try_element_at(parts, F.lit(1)).try_cast("int")
    return minute * 60 + F.try_element_at(parts, F.lit(2)).try_cast("int")


def elapsed_seconds(
    clock: Column, period: Column, n_periods: int = 4, length: int = 720, overtime: int = 300
) -> Column:
    """Countdown clock and period number to seconds since the start."""
    regular = length - clock + length * (period - 1)
    extra = overtime - clock + length * n_periods + overtime * (period - n_periods - 1)
    return F.when((period >= 1) & (period <= n_periods), regular).when(period > n_periods, extra)


def game_seconds_remaining(
    quarter: Column, quarter_seconds: Column, n_periods: int = 4, length: int = 600
) -> Column:
    """Seconds left in the game; in overtime, in that overtime."""
    return F.when(
        quarter <= n_periods, quarter_seconds + (n_periods - quarter) * length
    ).otherwise(quarter_seconds)


def weekday(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def league_year(day: Column) -> Column:
    """Season a date belongs to: Oct-Dec start one, Jan-May end one."""
    y, m = F.year(day), F.month(day)
    span = lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))
    return F.when(m >= 10, span(y, y + 1)).when(m <= 5, span(y - 1, y))


def season_label(year: Column) -> Column:
    """2020 to ``2020-21``."""
    tail = F.lpad(((year + 1) % 100).cast("string"), 2, "0")
    return F.concat(year.cast("string"), F.lit("-"), tail)


def start_minutes(text: Column) -> Column:
    """``"7:30p"`` to minutes after midnight."""
    hour = F.regexp_extract(text, r"^(\d{1,2}):(\d{2})([ap])", 1).try_cast("int") % 12
    minute = F.regexp_extract(text, r"^(\d{1,2}):(\d{2})([ap])", 2).try_cast("int")
    noon = F.when(F.lower(text).contains("p"), 720).otherwise(0)
    return hour * 60 + minute + noon
