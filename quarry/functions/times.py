"""Time functions: normal stamps, ages as classes, states of exit codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exit codes with a state of their own.
EXIT_STATES = {0: "ok", 124: "timeout", 137: "killed"}
ARCHIVE_WARN, ARCHIVE_BROKEN = 7_200, 86_400
REFRESH_WARN, REFRESH_BROKEN = 7_200, 21_600


def normal_stamp(text: Column) -> Column:
    """An ISO stamp in UTC with milliseconds and Z; null if it is none.  Naive stamps are UTC."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_class(stamp: Column, now: Column, warn: int = ARCHIVE_WARN, broken: int = ARCHIVE_BROKEN) -> Column:
    """``ok``, ``warn`` or ``broken`` by age in seconds; ``broken`` without a stamp."""
    # whole microseconds: a fraction of a second beyond a limit is beyond it
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))
    warn, broken = warn * 1_000_000, broken * 1_000_000
    return F.when(age.isNull() | (age > broken), "broken").when(age > warn, "warn").otherwise("ok")


def exit_state(code: Column) -> Column:
    out = F.lit("failed")
    for known, state in EXIT_STATES.items():
        out = F.when(code == known, state).otherwise(out)
    return out
