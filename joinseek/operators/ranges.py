"""Which rows can match at all: those whose values lie within what the other side holds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from joinseek.functions.values import PARTS, key_parts, needs_text
from joinseek.session import settle

ColumnSet = tuple[str, tuple[str, ...]]
Ends = tuple[str, tuple[str, ...], str, tuple[str, ...]]

#: A column as it is compared: its table, its name, and if as text.
Place = tuple[str, str, bool]


@dataclass(frozen=True)
class Range:
    """The least and the greatest value of each part of a key value, and if some are missing. Text is in hexadecimal."""

    bounds: Mapping[str, tuple]
    missing: bool

    def common(self, other: Range) -> Range:
        both = {}
        for p in self.bounds.keys() & other.bounds.keys():
            low, high = (f(a, b) for f, a, b in zip((max, min), self.bounds[p], other.bounds[p], strict=True))
            if low <= high:
                both[p] = (low, high)
        return Range(both, self.missing and other.missing)

    def around(self, other: Range) -> Range:
        every = dict(self.bounds)
        for p, (low, high) in other.bounds.items():
            own = every.get(p, (low, high))
            every[p] = (min(low, own[0]), max(high, own[1]))
        return Range(every, self.missing or other.missing)

    def __bool__(self) -> bool:
        return bool(self.bounds) or self.missing


#: Per column of a set the values it may meet: as they are or as text, by how they are compared.
Limits = list[dict[bool, Range]]


def _literal(part: str, value) -> str:
    return f"CAST(X'{value}' AS STRING)" if part == "s" else f"CAST('{value!r}' AS {PARTS[part]})"


def _ranges(tables: Mapping[str, DataFrame], places: Sequence[Place]) -> dict[Place, Range]:
    """One scan of each table, of the columns asked for."""
    found = {}
    for table in sorted({t for t, _, _ in places}):
        mine = sorted(p for p in places if p[0] == table)
        values, asked, parts = [], [], {}
        for n, (_, column, as_text) in enumerate(mine):
            parts[n] = key_parts(column, tables[table].schema[column].dataType, as_text)
            values += [f"{value} AS {p}{n}" for p, value in parts[n].items()]
            for p in parts[n]:
                shown = "hex(CAST({} AS BINARY))" if p == "s" else "{}"
                asked += [f"{shown.format(f'{f}({p}{n})')} AS {f}_{p}{n}" for f in ("min", "max")]
            asked.append(f"count_if({' AND '.join(f'{p}{n} IS NULL' for p in parts[n])}) > 0 AS missing{n}")
        row = settle(tables[table].selectExpr(*values).selectExpr(*asked)).first()
        for n, place in enumerate(mine):
            bounds = {p: (row[f"min_{p}{n}"], row[f"max_{p}{n}"]) for p in parts[n]}
            found[place] = Range({p: b for p, b in bounds.items() if b[0] is not None}, row[f"missing{n}"])
    return found


def within(schema: T.StructType, columns: Sequence[str], limits: Limits, alias: Callable[[str], str]) -> str:
    """True if all values of a key lie within the limits, SQL text; ``alias`` names a converted value."""
    tests = []
    for column, by_kind in zip(columns, limits, strict=True):
        passed = []
        for as_text, limit in by_kind.items():
            values = {p: alias(v) for p, v in key_parts(column, schema[column].dataType, as_text).items()}
            for p, value in values.items():
                if p in limit.bounds:
                    low, high = (_literal(p, v) for v in limit.bounds[p])
                    passed.append(f"coalesce({value} BETWEEN {low} AND {high}, false)")
            if limit.missing:
                passed.append(f"({' AND '.join(f'{value} IS NULL' for value in values.values())})")
        tests.append(f"({' OR '.join(passed) or 'false'})")
    return f"({' AND '.join(tests)})"


def matchable(tables: Mapping[str, DataFrame], pairs: Sequence[Ends]) -> tuple[list[Ends], dict[ColumnSet, Limits]]:
    """The pairs of column sets that can have keys in common, and the limits of the keys of their sets.

    A value must lie within the values of some column it is compared with, a
    missing one meet a missing one. What is left out matches nothing; what is
    kept may match nothing either.
    """

    def compared(pair: Ends) -> list[tuple[Place, Place]]:
        found = []
        for x, y in zip(pair[1], pair[3], strict=True):
            as_text = any(needs_text(tables[t].schema[c].dataType) for t, c in ((pair[0], x), (pair[2], y)))
            found.append(((pair[0], x, as_text), (pair[2], y, as_text)))
        return found

    ranges = _ranges(tables, sorted({place for pair in pairs for both in compared(pair) for place in both}))
    live = [pair for pair in pairs if all(ranges[x].common(ranges[y]) for x, y in compared(pair))]
    limits: dict[ColumnSet, Limits] = {}
    for pair in live:
        for n, both in enumerate(compared(pair)):
            for at, (own, other) in ((0, both), (2, both[::-1])):
                columns = limits.setdefault((pair[at], pair[at + 1]), [{} for _ in pair[1]])
                known = columns[n].get(own[2])
                columns[n][own[2]] = known.around(ranges[other]) if known else ranges[other]
    return live, limits
