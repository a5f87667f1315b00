"""Key tuples of many column sets at once, and in which column sets each occurs.

A *column set* is a table with a list of its columns; its keys are the distinct
value tuples of those columns. Every table is scanned once for all its column
sets. Each key carries a bit mask with one bit per column set, and masks are
or-ed while grouping by key, already before the shuffle, so a hot value travels
at most once per task. Counting keys per mask then answers both "how many
distinct keys has this column set" and "how many keys do these two share".
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinseek.functions.values import PARTS, key_fields, key_parts, needs_text, set_codes, typed_values
from joinseek.operators.homes import HOME_ROWS, PART_ROWS, Side, home_sums
from joinseek.operators.levels import level_counts
from joinseek.operators.profile import union_all
from joinseek.operators.ranges import Limits, matchable, within
from joinseek.session import local_table, quoted, settle

ColumnSet = tuple[str, tuple[str, ...]]
Ends = tuple[str, tuple[str, ...], str, tuple[str, ...]]

BITS = 63
SETS_PER_PASS = 8 * BITS

#: Up to so many column sets share masks also if each of them is in one pair only.
MASKED_SETS = BITS

#: Over tables of so many rows together, sets of several columns that are each in one pair never share masks:
#: a key of every row and set would travel, nearly all of them different.
MASKED_ROWS = 1_000_000


class KeyLayout:
    """The typed columns that hold the keys of some column sets.

    Position i of a key has the columns ``l{i}``, ``d{i}``, ``s{i}`` as far as a
    column at that position needs them; shorter keys are padded with nulls.
    """

    def __init__(self, tables: Mapping[str, DataFrame], sets: Sequence[ColumnSet]):
        self.schemas = {name: tables[name].schema for name, _ in sets}
        self.width = max(len(columns) for _, columns in sets)
        types = [
            [self.schemas[name][columns[i]].dataType for name, columns in sets if len(columns) > i]
            for i in range(self.width)
        ]
        self.as_text = [any(needs_text(t) for t in at) for at in types]
        self.parts: list[list[str]] = [
            [p for p in PARTS if any(p in key_parts("x", t, text) for t in at)]
            for at, text in zip(types, self.as_text, strict=True)
        ]

    @property
    def names(self) -> list[str]:
        """The columns to group keys by; keys of several widths differ by arity."""
        parts = [f"{p}{i}" for i, at in enumerate(self.parts) for p in at]
        return parts if self.width == 1 else ["arity", *parts]

    def has_null(self) -> str:
        """True if a value of the key is missing, padding aside."""
        tests = []
        for i, parts in enumerate(self.parts):
            absent = " AND ".join(f"{p}{i} IS NULL" for p in parts)
            tests.append(f"({absent})" if self.width == 1 else f"(arity > {i} AND {absent})")
        return " OR ".join(tests)

    def rows(
        self,
        df: DataFrame,
        keys: Sequence[tuple[ColumnSet, Mapping[str, str]]],
        flags: Mapping[str, str] | None = None,
        limits: Mapping[ColumnSet, Limits] | None = None,
    ) -> DataFrame:
        """One row per input row and key: the extra fields and the key columns.

        ``keys`` are column sets of this table with extra fields as SQL text;
        ``flags`` are further expressions the extra fields may name. Each column
        is converted once per row, whatever the number of sets it is in. With
        ``limits`` there are only keys whose values lie within those of their set.
        """
        prepared: dict[str, str] = {}
        rows, tests = [], []

        def alias(value: str) -> str:
            return prepared.setdefault(value, f"v{len(prepared)}")

        for (name, columns), extra in keys:
            fields = dict(extra)
            if self.width > 1:
                fields["arity"] = f"{len(columns)}Y"
            for i, parts in enumerate(self.parts):
                values = {}
                if i < len(columns):
                    dtype = self.schemas[name][columns[i]].dataType
                    values = key_parts(columns[i], dtype, self.as_text[i])
                for p in parts:
                    held = f"CAST(NULL AS {PARTS[p]})"
                    if p in values:
                        held = alias(values[p])
                    fields[f"{p}{i}"] = held
            if limits is not None:
                tests.append(within(self.schemas[name], columns, limits[name, columns], alias))
            rows.append(fields)
        converted = df.selectExpr(
            *(f"{value} AS {name}" for value, name in prepared.items()),
            *(f"{value} AS {name}" for name, value in (flags or {}).items()),
            # Without it Spark would convert the values anew inside the filter.
            *(["spark_partition_id() AS part"] if tests else []),
        )
        if tests:
            converted = converted.where(f"part >= 0 AND ({' OR '.join(tests)})")
        if len(rows) == 1:
            return converted.selectExpr(*(f"{value} AS {field}" for field, value in rows[0].items()))
        for r, test in zip(rows, tests):
            r["kept"] = test
        structs = (f"named_struct({', '.join(f"'{field}', {value}" for field, value in r.items())})" for r in rows)
        spread = converted.selectExpr(f"inline(array({', '.join(structs)}))")
        return spread.where("kept").drop("kept") if tests else spread


def _masks(index: int, words: int) -> dict[str, str]:
    return {f"w{w}": f"{1 << (index % BITS) if index // BITS == w else 0}L" for w in range(words)}


def key_masks(
    tables: Mapping[str, DataFrame], sets: Sequence[ColumnSet], layout: KeyLayout, limits: Mapping[ColumnSet, Limits] | None = None
) -> DataFrame:
    """One row per distinct key with the or-ed masks of its column sets, with ``limits`` only keys within them."""
    words = (len(sets) + BITS - 1) // BITS
    frames = []
    for name, df in tables.items():
        mine = [(s, _masks(i, words)) for i, s in enumerate(sets) if s[0] == name]
        if mine:
            frames.append(layout.rows(df, mine, limits=limits))
    masks = [F.bit_or(f"w{w}").alias(f"w{w}") for w in range(words)]
    return union_all(frames).groupBy(*layout.names).agg(*masks)


def _members(words: int, total: int) -> str:
    """The numbers of the column sets whose bits are set."""
    mask = f"array({', '.join(f'w{w}' for w in range(words))})"
    word = f"get({mask}, CAST(floor(i / {BITS}) AS INT))"
    return f"filter(sequence(0, {total - 1}), i -> (shiftright({word}, i % {BITS}) & 1L) = 1L)"


def _held(
    tables: Mapping[str, DataFrame], sets: Sequence[ColumnSet], wanted: DataFrame, limits: Mapping[ColumnSet, Limits] | None = None
) -> DataFrame:
    """Key counts of every mask, once per wanted row whose sets are both in it.

    ``wanted`` has first and second, numbers of column sets, and more.
    """
    words = (len(sets) + BITS - 1) // BITS
    layout = KeyLayout(tables, sets)
    per_mask = (
        key_masks(tables, sets, layout, limits)
        .groupBy(*(f"w{w}" for w in range(words)), F.expr(layout.has_null()).alias("has_null"))
        .agg(F.expr("count(1) AS keys"))
    )
    members = per_mask.selectExpr("has_null", "keys", f"{_members(words, len(sets))} AS members")
    # The outer form, lest Spark tests the array of every key before counting.
    held = members.selectExpr("*", "explode_outer(members) AS first").join(wanted, "first")
    return held.where("array_contains(members, second)")


def _numbered_keys(
    df: DataFrame, first: int, sets: Sequence[tuple[str, ...]], width: int, slicer: Mapping[tuple[str, ...], str] | None = None, slices: int = 1
) -> DataFrame:
    """One row per input row and column set: the number of the set and its key.

    A set is a number whose digits, to the base of the number of columns plus
    one, name its columns; all of them are one constant array, so the plan has the
    same size for ten sets and for ten thousand. With a ``slicer``, a column of
    each set, only the rows of one in ``slices`` of its values are taken.
    """
    used = sorted({c for columns in sets for c in columns})
    values = typed_values(df.schema, used)
    numbers, base = set_codes(used, sets)
    codes = [f"{n}L" for n in numbers]
    if slicer is None:
        rows = df.selectExpr(f"array({', '.join(values)}) AS held").selectExpr("held", f"posexplode(array({', '.join(codes)})) AS (at, code)")
    else:
        mine: dict[str, list[int]] = {}
        for at, columns in enumerate(sets):
            mine.setdefault(slicer[columns], []).append(at)
        parts = []
        for name, numbers in sorted(mine.items()):
            entries = ", ".join(f"named_struct('at', {at}, 'code', {codes[at]})" for at in numbers)
            parts.append(f"IF(pmod(xxhash64({quoted(name)}), {slices}) = 0, array({entries}), array())")
        taken = df.selectExpr(f"array({', '.join(values)}) AS held", f"concat({', '.join(parts)}) AS taken").where("size(taken) > 0")
        rows = taken.selectExpr("held", "inline(taken)")
    return rows.selectExpr(f"at + {first} AS id", *key_fields(base, width))


def key_counts(spark: SparkSession, tables: Mapping[str, DataFrame], sets: Sequence[ColumnSet]) -> DataFrame:
    """Distinct keys per column set, missing values included: (table, columns, keys).

    One scan per table and one shuffle, before which keys are de-duplicated; tables
    of ``HOME_ROWS`` rows and more are dealt out by home column, or once per set if
    that is no more often. Sets of different tables do not meet, so their values
    need no common type.
    """
    ordered = sorted(sets)
    width = max(len(columns) for _, columns in ordered)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frames, found = [], []
    for name, df in tables.items():
        mine = [i for i, (t, _) in enumerate(ordered) if t == name]
        if mine and (rows := df.count()) >= HOME_ROWS:
            used = sorted({c for i in mine for c in ordered[i][1]})
            if len(mine) <= len(used):
                found.append(_dealt_counts(spark, df, {i: ordered[i][1] for i in mine}, max(parts, -(-rows // PART_ROWS))))
                continue
            places = {i: [used.index(c) for c in ordered[i][1]] for i in mine}
            found.append(home_sums([Side(0, df, used)], places, rows, parts).selectExpr("id", f"{rows} + more_left AS keys"))
        elif mine:
            frames.append(_numbered_keys(df, mine[0], [ordered[i][1] for i in mine], width))
    if frames:
        found.append(union_all(frames).distinct().groupBy("id").agg(F.expr("count(1) AS keys")))
    counts = union_all(found)
    names = local_table(
        spark,
        {"id": list(range(len(ordered))), "table": [t for t, _ in ordered], "columns": [list(c) for _, c in ordered]},
        {"id": pa.int32(), "table": pa.string(), "columns": pa.list_(pa.string())},
    )
    return names.join(counts, "id", "left").drop("id").na.fill(0, ["keys"])


def _dealt_counts(spark: SparkSession, df: DataFrame, sets: Mapping[int, Sequence[str]], parts: int) -> DataFrame:
    """(id, keys) of few column sets of a large table, one shuffle per set and one set at a time.

    Rows are dealt out by the whole key as they are: where most keys are held by
    one row, de-duplicating them before the shuffle costs more than it saves.
    """
    counts = []
    for columns in sets.values():
        values = {f"{p}{n}": v for n, c in enumerate(columns) for p, v in key_parts(c, df.schema[c].dataType).items()}
        dealt = df.selectExpr(*(f"{v} AS {p}" for p, v in values.items())).repartition(parts, *values)
        each = dealt.groupBy(*values).agg(F.expr("count(1) AS n"))
        counts.append(settle(each.agg(F.expr("count(1) AS keys"))).first()["keys"])
    return local_table(spark, {"id": list(sets), "keys": counts}, {"id": pa.int32(), "keys": pa.int64()})


def duplicate_witnesses(
    spark: SparkSession, tables: Mapping[str, DataFrame], sets: Mapping[ColumnSet, str], slices: int
) -> DataFrame:
    """(table, columns, duplicates): rows beyond the first of their key, as far as a slice shows them.

    Each set is seen where one of its columns, named in ``sets``, has one in
    ``slices`` of its values. All rows of a key are in the slice or none is, so the
    duplicates there are true ones, and a set has no more keys than rows less them.
    """
    ordered = sorted(sets)
    width = max(len(columns) for _, columns in ordered)
    frames = []
    for name, df in tables.items():
        mine = [i for i, (t, _) in enumerate(ordered) if t == name]
        if mine:
            slicer = {ordered[i][1]: sets[ordered[i]] for i in mine}
            frames.append(_numbered_keys(df, mine[0], [ordered[i][1] for i in mine], width, slicer, slices))
    rows = union_all(frames)
    keys = rows.groupBy(*rows.columns).agg(F.expr("count(1) - 1 AS more"))
    seen = keys.groupBy("id").agg(F.sum("more").alias("duplicates"))
    names = local_table(
        spark,
        {"id": list(range(len(ordered))), "table": [t for t, _ in ordered], "columns": [list(c) for _, c in ordered]},
        {"id": pa.int32(), "table": pa.string(), "columns": pa.list_(pa.string())},
    )
    return names.join(seen, "id", "left").drop("id").na.fill(0, ["duplicates"])


SUMS = {
    "n_left": "sum(IF(role = 0, keys, 0))",
    "n_right": "sum(IF(role = 1, keys, 0))",
    "common": "sum(IF(role = 2, keys, 0))",
    "full_common": "sum(IF(role = 2 AND NOT has_null, keys, 0))",
}


def _separate_counts(tables: Mapping[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """``pair_counts`` of pairs that share no column set: a key carries its pair and two bits.

    Masks would be as wide as all sets and never hold more than one pair. All
    pairs are one pass, and the plan has the same size for any number of them.
    """
    rows = pairs.select("left_table", "right_table", "left", "right").collect()
    wanted = sorted((r.left_table, tuple(r.left), r.right_table, tuple(r.right)) for r in rows)
    width = max(len(left) for _, left, _, _ in wanted)
    frames = []
    for bit, at in ((1, 0), (2, 2)):
        for table in sorted({w[at] for w in wanted}):
            ids = [i for i, w in enumerate(wanted) if w[at] == table]
            keys = _numbered_keys(tables[table], 0, [wanted[i][at + 1] for i in ids], width)
            number = f"get(array({', '.join(map(str, ids))}), id) AS id"
            frames.append(keys.selectExpr(number, *keys.columns[1:], f"{bit} AS side"))
    every = union_all(frames)
    keys = every.groupBy(*every.columns[:-1]).agg(F.bit_or("side").alias("sides"))
    arity = f"get(array({', '.join(str(len(w[1])) for w in wanted)}), id)"
    absent = (f"({arity} > {i} AND {' AND '.join(f'{p}{i} IS NULL' for p in PARTS)})" for i in range(width))
    keys = keys.selectExpr("id", "sides", f"({' OR '.join(absent)}) AS has_null")
    tests = {
        "n_left": "sides & 1 = 1",
        "n_right": "sides & 2 = 2",
        "common": "sides = 3",
        "full_common": "sides = 3 AND NOT has_null",
    }
    sums = keys.groupBy("id").agg(*(F.expr(f"count_if({test})").alias(name) for name, test in tests.items()))
    text, many = pa.string(), pa.list_(pa.string())
    names = local_table(
        pairs.sparkSession,
        {
            "id": list(range(len(wanted))),
            "left_table": [w[0] for w in wanted],
            "left": [list(w[1]) for w in wanted],
            "right_table": [w[2] for w in wanted],
            "right": [list(w[3]) for w in wanted],
        },
        {"id": pa.int32(), "left_table": text, "left": many, "right_table": text, "right": many},
    )
    counted = names.join(sums, "id", "left").drop("id").na.fill(0, list(tests))
    return pairs.join(counted, ["left_table", "right_table", "left", "right"]).select(*pairs.columns, *tests)


def _set_sizes(
    spark: SparkSession, tables: Mapping[str, DataFrame], sets: Sequence[ColumnSet], totals: Mapping[str, int], known: DataFrame | None
) -> dict[ColumnSet, int]:
    """The number of keys of every set: as known, as many as rows if some of its columns have that, or counted.

    The order of columns makes no difference to it.
    """
    sizes: dict[tuple[str, frozenset[str]], int] = {}
    if known is not None:
        used = {t for t, _ in sets}
        sizes = {(r.table, frozenset(r.columns)): r["keys"] for r in known.where("keys IS NOT NULL").collect() if r.table in used}
    unique = [k for k, keys in sizes.items() if keys == totals[k[0]]]
    asked = {(t, frozenset(columns)) for t, columns in sets}
    for t, columns in asked - set(sizes):
        if any(t == other and part <= columns for other, part in unique):
            sizes[t, columns] = totals[t]
    if left := sorted((t, tuple(sorted(columns))) for t, columns in asked - set(sizes)):
        for r in key_counts(spark, {t: tables[t] for t in sorted({t for t, _ in left})}, left).collect():
            sizes[r.table, frozenset(r.columns)] = r["keys"]
    return {(t, columns): sizes[t, frozenset(columns)] for t, columns in sets}


def _ranged_counts(
    tables: Mapping[str, DataFrame], pairs: DataFrame, sets: Sequence[ColumnSet], totals: Mapping[str, int], known: DataFrame | None
) -> DataFrame:
    """``pair_counts`` of pairs over large tables that share column sets of several columns.

    The sizes of the sets are told apart from what they have in common, for which
    only rows are turned into keys whose values all lie within what the other side
    holds in those places. A pair without such a row has nothing in common.
    """
    spark = pairs.sparkSession
    sizes = _set_sizes(spark, tables, sets, totals, known)
    rows = pairs.select("left_table", "right_table", "left", "right").collect()
    wanted = sorted({(r.left_table, tuple(r.left), r.right_table, tuple(r.right)) for r in rows})
    live, limits = matchable(tables, wanted)
    n_left, n_right = ([sizes[w[at], w[at + 1]] for w in wanted] for at in (0, 2))
    counted = _ends_table(spark, wanted, {"n_left": n_left, "n_right": n_right})
    ends = ["left_table", "left", "right_table", "right"]
    if live:
        found = _masked_counts(tables, _ends_table(spark, live, {}), sorted(limits), limits).select(*ends, "common", "full_common")
        counted = counted.join(found, ends, "left").na.fill(0, ["common", "full_common"])
    else:
        counted = counted.selectExpr("*", "0L AS common", "0L AS full_common")
    return pairs.join(counted, ends).select(*pairs.columns, *SUMS)


def _ends_table(spark: SparkSession, ends: Sequence[Ends], counts: Mapping[str, list[int]]) -> DataFrame:
    text, many = pa.string(), pa.list_(pa.string())
    kinds = {"left_table": text, "left": many, "right_table": text, "right": many}
    columns = [list(c) if i % 2 == 0 else [list(x) for x in c] for i, c in enumerate(zip(*ends, strict=True))]
    return local_table(spark, dict(zip(kinds, columns, strict=True)) | dict(counts), kinds | dict.fromkeys(counts, pa.int64()))


def pair_counts(tables: Mapping[str, DataFrame], pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``pairs`` (left_table, right_table, left, right) with their key counts.

    ``n_left`` and ``n_right`` are the distinct keys of either side, ``common``
    those of both, a missing value equal to a missing value, and ``full_common``
    those without missing values.

    The driver reads the distinct column sets to build the scans; pairs meet their
    counts by number of the set. All pairs share one scan of each table and one
    shuffle by key; a pass holds at most ``SETS_PER_PASS`` column sets, so that a
    mask is a few words wide however many pairs there are. Many pairs that share no
    column set carry the number of the pair instead of a mask, level by level if
    some have several columns; so do few with several columns over large tables.
    Those that share column sets there leave out rows that cannot match, and take
    the sizes of sets from ``known`` (table, columns, keys) as far as it has them.
    """
    sides = [pairs.selectExpr(f"{side}_table AS table", f"{side} AS columns") for side in ("left", "right")]
    sets = sorted((r.table, tuple(r.columns)) for r in sides[0].unionAll(sides[1]).distinct().collect())
    plain = not any(needs_text(tables[t].schema[c].dataType) for t, columns in sets for c in columns)
    wide = any(len(columns) > 1 for _, columns in sets)
    totals = {t: tables[t].count() for t in sorted({t for t, _ in sets})} if wide else {}
    large = sum(totals.values()) >= MASKED_ROWS
    if (large or len(sets) > MASKED_SETS) and plain and len(sets) == 2 * pairs.count():
        return level_counts(tables, pairs) if wide else _separate_counts(tables, pairs)
    if wide and large:
        return _ranged_counts(tables, pairs, sets, totals, known)
    return _masked_counts(tables, pairs, sets)


def _masked_counts(
    tables: Mapping[str, DataFrame], pairs: DataFrame, sets: Sequence[ColumnSet], limits: Mapping[ColumnSet, Limits] | None = None
) -> DataFrame:
    """``pair_counts`` by masks; with ``limits`` only the keys in common are right, as those beyond them are not counted."""
    numbers = local_table(
        pairs.sparkSession,
        {"number": list(range(len(sets))), "table": [t for t, _ in sets], "columns": [list(c) for _, c in sets]},
        {"number": pa.int32(), "table": pa.string(), "columns": pa.list_(pa.string())},
    )
    numbered = pairs
    for side, name in (("left", "first"), ("right", "second")):
        own = numbers.selectExpr(f"table AS {side}_table", f"columns AS {side}", f"number AS {name}")
        numbered = numbered.join(own, [f"{side}_table", side])
    block = len(sets) if len(sets) <= SETS_PER_PASS else SETS_PER_PASS // 2
    numbered = numbered.selectExpr("*", *(f"CAST({n} div {block} AS INT) AS {n}_block" for n in ("first", "second")))
    passes = [(0, 0)]
    if block < len(sets):
        both = numbered.selectExpr("least(first_block, second_block) AS a", "greatest(first_block, second_block) AS b")
        passes = sorted((r.a, r.b) for r in both.distinct().collect())

    frames = []
    for a, b in passes:
        mine = sets[a * block : (a + 1) * block] + (sets[b * block : (b + 1) * block] if b > a else [])
        local = (f"{n} - IF({n}_block = {a}, {a * block}, {(b - 1) * block}) AS {n}" for n in ("first", "second"))
        part = numbered.where(f"least(first_block, second_block) = {a} AND greatest(first_block, second_block) = {b}")
        part = part.selectExpr(*pairs.columns, *local)
        roles = ", ".join(
            f"named_struct('role', {role}, 'first', {x}, 'second', {y})"
            for role, (x, y) in enumerate([("l", "l"), ("r", "r"), ("l", "r")])
        )
        wanted = part.selectExpr("first AS l", "second AS r").distinct().selectExpr("l", "r", f"inline(array({roles}))")
        sums = _held(tables, mine, wanted, limits).groupBy("l", "r").agg(*(F.expr(s).alias(n) for n, s in SUMS.items()))
        joined = part.join(sums, (F.col("first") == F.col("l")) & (F.col("second") == F.col("r")), "left")
        frames.append(joined.select(*pairs.columns, *SUMS).na.fill(0, list(SUMS)))
    return union_all(frames)
