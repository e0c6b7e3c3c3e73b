"""Working days (Monday to Friday) in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPRINT_STEP = 9


def next_workday(d: Column) -> Column:
    """The day itself, or the Monday after a weekend."""
    return F.date_add(d, F.when(F.weekday(d) == 5, 2).when(F.weekday(d) == 6, 1).otherwise(0))


def add_workdays(d: Column, n: Column | int) -> Column:
    """``n`` working days on from the next working day."""
    n = F.lit(n) if isinstance(n, int) else n
    s = next_workday(d)
    return F.date_add(s, (n + 2 * F.floor((F.weekday(s) + n) / 5)).cast("int"))


def sprint(as_of: Column, rank: Column) -> tuple[Column, Column]:
    """Start and end of the rank-th sprint in a chain in which each starts on the day the one before ends."""
    return add_workdays(as_of, SPRINT_STEP * (rank - 1)), add_workdays(as_of, SPRINT_STEP * rank)


def vsm_date(as_of: Column) -> Column:
    """The first working day after the day."""
    return next_workday(F.date_add(as_of, 1))
