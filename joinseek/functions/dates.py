"""Tolerant date test for string columns: day-first and month-first readings."""

from __future__ import annotations

# The date shapes that count, each with an optional time of day.
TIME = r"([ T]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?"
YEAR_FIRST = r"^\s*\d{4}([-/.])\d{1,2}\1\d{1,2}" + TIME + r"\s*$"
YEAR_LAST = r"^\s*\d{1,2}([-/.])\d{1,2}\1\d{4}" + TIME + r"\s*$"


DAY_FIRST, MONTH_FIRST = 1, 2


def date_reading(value: str) -> str:
    """SQL text: under which day/month orders is this string a calendar date?

    The sum of ``DAY_FIRST`` and ``MONTH_FIRST`` as far as they hold, 0 if none;
    ISO (year-first) dates are valid under both. Text that does not begin with a
    digit or fails the regular expression is never parsed.
    """
    day = f"substring_index(translate(trim({value}), 'T/.', ' --'), ' ', 1)"
    both = DAY_FIRST + MONTH_FIRST

    def worth(fmt: str, mark: int) -> str:
        return f"IF(try_to_timestamp({day}, '{fmt}') IS NULL, 0, {mark})"

    return (
        f"CASE WHEN {value} IS NULL OR ascii(trim({value})) NOT BETWEEN 48 AND 57 THEN 0 "
        f"WHEN rlike({value}, r'{YEAR_FIRST}') THEN {worth('yyyy-M-d', both)} "
        f"WHEN rlike({value}, r'{YEAR_LAST}') THEN {worth('d-M-yyyy', DAY_FIRST)} + {worth('M-d-yyyy', MONTH_FIRST)} "
        "ELSE 0 END"
    )
