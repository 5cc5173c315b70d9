"""Five-field cron schedules as boolean expressions over a timestamp (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import InvalidRequest

# Macros, and the bounds of minute, hour, day, month, weekday (0 is Sunday).
MACROS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
BOUNDS = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 6)]

# Periodic jobs and their schedules.
DEFAULT_JOBS = {
    "shard-gc": "*/2 * * * *",
    "event-reaper": "* * * * *",
    "inbox-cleanup": "0 * * * *",
    "media-gc-mark": "*/5 * * * *",
    "media-gc-sweep": "*/15 * * * *",
    "media-upload-abort": "*/5 * * * *",
    "event-cleanup": "0 */6 * * *",
}


def _part(text: str, low: int, high: int) -> set[int]:
    base, _, step = text.partition("/")
    first, dash, last = base.partition("-")
    try:
        a, b = (low, high) if base == "*" else (int(first), int(last) if dash else (high if step else int(first)))
        by = int(step) if step else 1
    except ValueError as e:
        raise InvalidRequest(f"bad cron field {text!r}") from e
    if not (low <= a <= b <= high) or by <= 0 or ("/" in text and not step):
        raise InvalidRequest(f"cron field {text!r} is out of range")
    return set(range(a, b + 1, by))


def fields(expression: str) -> list[set[int]]:
    parts = MACROS.get(expression.strip(), expression).split()
    if len(parts) != len(BOUNDS):
        raise InvalidRequest("a cron expression has five fields")
    return [set().union(*(_part(p, *b) for p in part.split(","))) for part, b in zip(parts, BOUNDS, strict=True)]


def is_due(expression: str, at: Column | str) -> Column:
    """Whether a moment falls in the schedule; day of month and weekday must both fit."""
    at = F.col(at) if isinstance(at, str) else at
    got = [F.minute(at), F.hour(at), F.dayofmonth(at), F.month(at), F.dayofweek(at) - 1]
    out = F.lit(True)
    for value, allowed, (low, high) in zip(got, fields(expression), BOUNDS, strict=True):
        if len(allowed) < high - low + 1:
            out = out & value.isin(*sorted(allowed))
    return out
