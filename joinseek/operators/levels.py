"""Key counts of pairs of column sets, level by level.

A row whose values in some columns are found in no other row of either side has a
key of its own in every larger set that holds those columns. Such rows are told
from the counts of the smaller sets and left out of the larger ones, where they
are one key each and match nothing. Only the other rows are turned into keys and
shuffled. Large tables are dealt out by home column instead (``homes``), since the
keys of all levels would be many times the tables.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.functions.values import PARTS, key_fields, set_codes, typed_values
from joinseek.operators.homes import HOME_ROWS, Side, home_sums
from joinseek.operators.profile import union_all
from joinseek.session import local_table, written

Pair = tuple[str, tuple[str, ...], str, tuple[str, ...]]
BITS = 63

#: Where a pair holds the table of either side.
SIDES = (0, 2)


def _columns(pair: Pair) -> frozenset[tuple[str, str]]:
    return frozenset(zip(pair[1], pair[3], strict=True))


def _bits(numbers: list[int], words: int) -> list[int]:
    return [sum(1 << (n % BITS) for n in numbers if n // BITS == w) for w in range(words)]


def _inner_pairs(pairs: list[Pair]) -> list[list[int]]:
    """For every pair the numbers of those over a part of its columns."""
    number: dict = {}
    for i, p in enumerate(pairs):
        number.setdefault((p[0], p[2], _columns(p)), i)
    found = []
    for p in pairs:
        parts = [frozenset(c) for k in range(1, len(p[1])) for c in combinations(sorted(_columns(p)), k)]
        found.append([number[p[0], p[2], part] for part in parts if (p[0], p[2], part) in number])
    return found


def level_counts(tables: Mapping[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """``pairs`` with n_left, n_right, common and full_common, as ``pair_counts`` gives them.

    The single pairs of columns come first, asked for or not, then the pairs of
    each width. Every level is one shuffle by key, before which keys are counted,
    and one by row of the marks of rows alone in a key. The tables are written
    once as typed values with a number per row, so that a lost task finds the same
    numbers again. Tables of ``HOME_ROWS`` rows and more are counted by home.
    """
    rows = pairs.select("left_table", "right_table", "left", "right").collect()
    wanted = {(r.left_table, tuple(r.left), r.right_table, tuple(r.right)) for r in rows}
    totals = {t: tables[t].count() for t in sorted({p[at] for p in wanted for at in SIDES})}
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if sum(totals.values()) >= HOME_ROWS:
        every = sorted(wanted, key=lambda p: (len(p[1]), p))
        return _with_sums(pairs, every, every, totals, _home_counts(tables, every, totals, parts))
    single = {(a, (x,), b, (y,)) for a, left, b, right in wanted for x, y in zip(left, right, strict=True)}
    every: list[Pair] = sorted(wanted | single, key=lambda p: (len(p[1]), p))
    inner = _inner_pairs(every)
    widths = sorted({len(p[1]) for p in every})
    words = max(1, -(-sum(len(p[1]) < widths[-1] for p in every) // BITS))

    used: dict[str, list[str]] = {}
    for p in every:
        for at in SIDES:
            used[p[at]] = sorted({*used.get(p[at], []), *p[at + 1]})
    names = sorted(used)
    # The rows are dealt out first: each becomes as many keys as there are pairs, which one task would make
    # of a table in one row group, and adaptive execution would put small partitions together again.
    held = {}
    for t in names:
        typed = tables[t].selectExpr(f"array({', '.join(typed_values(tables[t].schema, used[t]))}) AS held")
        held[t] = written(typed.repartition(parts).selectExpr("held", "monotonically_increasing_id() AS row"))

    marks, sums = None, []
    for width in widths:
        numbers = [i for i, p in enumerate(every) if len(p[1]) == width]
        frames = []
        for at in SIDES:
            for table in sorted({every[i][at] for i in numbers}):
                mine = [i for i in numbers if every[i][at] == table]
                frames.append(_keys(held[table], used[table], every, inner, mine, at, marks, names.index(table), words, width, parts))
        each = union_all(frames)
        keys = each.groupBy("id", *each.columns[4:]).agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"), F.min("row").alias("row"))
        absent = (f"({width} > {i} AND {' AND '.join(f'{p}{i} IS NULL' for p in PARTS)})" for i in range(width))
        keys = keys.selectExpr("id", "nl", "nr", "row", f"({' OR '.join(absent)}) AS has_null")
        if width < widths[-1]:
            keys = written(keys)
            marks = written(_marks(keys, every, names, words, marks))
        sums.append(
            keys.groupBy("id").agg(
                F.expr("count_if(nl > 0) - sum(nl) AS more_left"),
                F.expr("count_if(nr > 0) - sum(nr) AS more_right"),
                F.expr("count_if(nl > 0 AND nr > 0) AS common"),
                F.expr("count_if(nl > 0 AND nr > 0 AND NOT has_null) AS full_common"),
            )
        )
    return _with_sums(pairs, every, [p for p in every if p in wanted], totals, union_all(sums))


def _home_counts(tables: Mapping[str, DataFrame], every: list[Pair], totals: Mapping[str, int], parts: int) -> DataFrame:
    """The sums of all pairs of column sets, tables of each pair of tables dealt out by home column."""
    found = []
    for left, right in sorted({(p[0], p[2]) for p in every}):
        mine = {i: p for i, p in enumerate(every) if (p[0], p[2]) == (left, right)}
        singles = sorted({c for p in mine.values() for c in _columns(p)})
        place = {c: n for n, c in enumerate(singles)}
        sides = [Side(k, tables[t], [c[k] for c in singles]) for k, t in enumerate((left, right))]
        sets = {i: [place[c] for c in zip(p[1], p[3], strict=True)] for i, p in mine.items()}
        found.append(home_sums(sides, sets, totals[left] + totals[right], parts))
    return union_all(found)


def _with_sums(
    pairs: DataFrame, every: list[Pair], wanted: list[Pair], totals: Mapping[str, int], sums: DataFrame
) -> DataFrame:
    """``pairs`` with their counts from (id, more_left, more_right, common, full_common)."""
    text, many, count = pa.string(), pa.list_(pa.string()), pa.int64()
    number = {p: i for i, p in enumerate(every)}
    known = {
        "id": (pa.int32(), [number[p] for p in wanted]),
        "left_table": (text, [p[0] for p in wanted]),
        "left": (many, [list(p[1]) for p in wanted]),
        "right_table": (text, [p[2] for p in wanted]),
        "right": (many, [list(p[3]) for p in wanted]),
        "rows_left": (count, [totals[p[0]] for p in wanted]),
        "rows_right": (count, [totals[p[2]] for p in wanted]),
    }
    listed = local_table(pairs.sparkSession, {k: v for k, (_, v) in known.items()}, {k: t for k, (t, _) in known.items()})
    counted = listed.join(sums, "id", "left").na.fill(0, ["more_left", "more_right", "common", "full_common"])
    # A row left out is a key of its own.
    counts = ["rows_left + more_left AS n_left", "rows_right + more_right AS n_right", "common", "full_common"]
    counted = counted.selectExpr("left_table", "left", "right_table", "right", *counts)
    return pairs.join(counted, ["left_table", "right_table", "left", "right"]).select(
        *pairs.columns, "n_left", "n_right", "common", "full_common"
    )


def _keys(
    held: DataFrame, used: list[str], every: list[Pair], inner: list[list[int]], mine: list[int], at: int,
    marks: DataFrame | None, table: int, words: int, width: int, parts: int,
) -> DataFrame:
    """(id, nl, nr, row, key) of the rows of one table for the pairs they may share a key in."""
    codes, base = set_codes(used, [every[i][at + 1] for i in mine])
    masks = [_bits(inner[i], words) for i in mine]
    entries = ", ".join(
        f"named_struct('id', {i}, 'code', {code}L, {', '.join(f"'m{w}', {m}L" for w, m in enumerate(mask))})"
        for i, code, mask in zip(mine, codes, masks, strict=True)
    )
    rows, taken = held, f"array({entries})"
    if marks is not None:
        own = marks.where(f"side = {at} AND tab = {table}").drop("side", "tab")
        rows = held.repartition(parts, "row").join(own.repartition(parts, "row"), "row", "left").na.fill(0, [f"w{w}" for w in range(words)])
        clear = " AND ".join(f"(e.m{w} & w{w}) = 0" for w in range(words))
        taken = f"filter({taken}, e -> {clear})"
    spread = rows.selectExpr("held", "row", f"inline({taken})")
    sides = ("1L AS nl", "0L AS nr") if at == 0 else ("0L AS nl", "1L AS nr")
    return spread.selectExpr("id", *sides, "row", *key_fields(base, width))


def _marks(keys: DataFrame, every: list[Pair], names: list[str], words: int, before: DataFrame | None) -> DataFrame:
    """(side, tab, row, w0, ...): in which pairs so far a row is alone with its key."""
    owner = {at: f"get(array({', '.join(str(names.index(p[at])) for p in every)}), id)" for at in SIDES}
    bits = (f"IF(id div {BITS} = {w}, shiftleft(1L, CAST(id % {BITS} AS INT)), 0L) AS w{w}" for w in range(words))
    alone = keys.where("nl + nr = 1").selectExpr(
        "IF(nl = 1, 0, 2) AS side", f"IF(nl = 1, {owner[0]}, {owner[2]}) AS tab", "row", *bits
    )
    if before is not None:
        alone = alone.unionAll(before)
    return alone.groupBy("side", "tab", "row").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(words)))
