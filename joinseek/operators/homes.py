"""Key counts of many column sets over large tables, without a row per set and input row.

Every key has one *home*: the first of its columns whose value is not hot, in the
order of most values first. Rows are dealt out once per home column, by its value;
all rows of a key lie in one part, so a part counts the keys of all its column sets
by itself. A table is shuffled as often as it has columns of many values, however
many sets these are in. Keys of hot values alone are few beside the rows: rows are
reduced to their hot values before any set is made of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinseek.functions.values import PARTS, key_fields, key_parts, set_codes
from joinseek.operators.profile import union_all
from joinseek.session import local_table, settle, written

#: Tables of fewer rows make a key of every row and set.
HOME_ROWS = 10_000

#: Rows a part holds on average, and more than any value that is not hot has.
PART_ROWS = 200_000

#: Tables of so many rows are dealt out in several slices of the home's values, one at a time, since all
#: columns travel: the disk taken at once is that of one slice of one home.
SLICED_ROWS = 5_000_000
SLICES = 2

#: A value is hot if more than one in so many of all rows hold it, so there are fewer hot values than this.
HOT_SHARE = 1000

#: Hot values are sought in so many buckets of values for every one there can be.
BUCKETS = 64

SUMS = ("more_left", "more_right", "common", "full_common")
BITS = 63


@dataclass(frozen=True)
class Side:
    """The rows of one side: 0 for left, 1 for right. Place i of ``columns`` is compared with place i of the other side."""

    number: int
    rows: DataFrame
    columns: Sequence[str]

    def parts(self, place: int) -> dict[str, str]:
        name = self.columns[place]
        return key_parts(name, self.rows.schema[name].dataType)


def home_sums(sides: Sequence[Side], sets: Mapping[int, Sequence[int]], rows: int, parts: int) -> DataFrame:
    """(id, more_left, more_right, common, full_common) of ``sets``, which name places by id.

    ``more`` is the number of keys less that of rows. ``rows`` are those of all
    sides; ``parts`` is the least number of parts to deal them into.
    """
    places = sorted({p for s in sets.values() for p in s})
    held = {p: [x for x in PARTS if any(x in side.parts(p) for side in sides)] for p in places}
    typed = [_typed(side, held) for side in sides]
    singles = {s[0]: i for i, s in sets.items() if len(s) == 1}
    values = []
    if singles:
        values += _value_counts(typed, {p: held[p] for p in places if p in singles}, rows)
    if len(singles) < len(places):
        values += _hot_values(typed, {p: held[p] for p in places if p not in singles}, rows)
    spark = sides[0].rows.sparkSession
    # Every set has a row, also if all its keys were told from those of smaller sets.
    known = {i: (0,) * len(SUMS) for i in sets}
    known |= {singles[r.place]: tuple(int(r[c]) for c in SUMS) for r in values if r.place in singles}
    kinds = {"id": pa.int32()} | dict.fromkeys(SUMS, pa.int64())
    columns = [list(known), *(list(c) for c in zip(*known.values(), strict=True))]
    found = [local_table(spark, dict(zip(kinds, columns, strict=True)), kinds)]
    wider = {i: tuple(s) for i, s in sets.items() if len(s) > 1}
    if wider:
        hot = {r.place: r.hot for r in values}
        by_keys = sorted(values, key=lambda r: (-r.keys, r.place))
        order = [r.place for r in by_keys]
        slices = SLICES if rows >= SLICED_ROWS else 1
        dealt = max(-(-parts // slices), -(-rows // (slices * PART_ROWS)))
        for place in (r.place for r in by_keys if r.keys > len(r.hot)):
            for n in range(slices):
                frame = _home(typed, held, wider, place, order, hot, dealt, (n, slices))
                if frame is not None:
                    found.append(written(_added(frame)))
        if (frame := _hot_sums(typed, held, wider, hot, max(parts, -(-rows // PART_ROWS)))) is not None:
            found.append(written(_added(frame)))
    return _added(union_all(found))


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy("id").agg(*(F.sum(c).alias(c) for c in SUMS))


def _typed(side: Side, held: Mapping[int, list[str]]) -> DataFrame:
    """(side, l0, d0, s0, ...) as far as a column of that place needs them."""
    fields = []
    for place, names in held.items():
        own = side.parts(place)
        fields += [f"{own.get(p, f'CAST(NULL AS {PARTS[p]})')} AS {p}{place}" for p in names]
    return side.rows.selectExpr(f"{side.number} AS side", *fields)


def _value_counts(typed: Sequence[DataFrame], held: Mapping[int, list[str]], rows: int) -> list[T.Row]:
    """Per place the counts of its values and those that are hot: fewer than ``HOT_SHARE`` of them."""
    entries = []
    for place, names in held.items():
        parts = (f"'{p}', {f'{p}{place}' if p in names else f'CAST(NULL AS {kind})'}" for p, kind in PARTS.items())
        entries.append(f"named_struct('place', {place}, {', '.join(parts)})")
    each = union_all([df.selectExpr("side", f"inline(array({', '.join(entries)}))") for df in typed])
    counted = each.groupBy("place", *PARTS).agg(F.expr("count_if(side = 0) AS nl"), F.expr("count_if(side = 1) AS nr"))
    limit = min(PART_ROWS, rows // HOT_SHARE)
    per_place = counted.groupBy("place").agg(
        F.expr("count(1) AS keys"),
        *_key_sums(" OR ".join(f"{p} IS NOT NULL" for p in PARTS)),
        F.expr(f"collect_list(CASE WHEN nl + nr > {limit} THEN named_struct('l', l, 'd', d, 's', s) END) AS hot"),
    )
    return settle(per_place).collect()


def _hot_values(typed: Sequence[DataFrame], held: Mapping[int, list[str]], rows: int) -> list[T.Row]:
    """Per place its hot values, as ``_value_counts`` finds them, without a count of every value.

    Rows are counted per bucket of values first: a hot value lies in a bucket of as many
    rows, so that only the values of such buckets are counted. ``keys`` tells whether
    there are others and orders the places; it is an estimate.
    """
    limit = min(PART_ROWS, rows // HOT_SHARE)
    buckets = BUCKETS * max(HOT_SHARE, rows // max(limit, 1))
    own = {p: ", ".join(f"{x}{p}" for x in names) for p, names in held.items()}
    every = union_all(list(typed)).selectExpr("*", *(f"xxhash64({c}) AS h{p}" for p, c in own.items()))
    bucket = {p: f"pmod(h{p}, {buckets})" for p in held}
    entries = (f"named_struct('place', {p}, 'bucket', {b})" for p, b in bucket.items())
    counted = every.selectExpr(f"inline(array({', '.join(entries)}))").groupBy("place", "bucket").agg(F.expr("count(1) AS n"))
    heavy: dict[int, list[str]] = {}
    for r in settle(counted.where(f"n > {limit}")).collect():
        heavy.setdefault(r.place, []).append(str(r.bucket))
    sizes = settle(every.agg(*(F.expr(f"approx_count_distinct(h{p}) AS keys{p}") for p in held))).first()
    hot: dict[int, list[T.Row]] = {p: [] for p in held}
    if heavy:
        entries = []
        for p, listed in sorted(heavy.items()):
            parts = (f"'{x}', {f'{x}{p}' if x in held[p] else f'CAST(NULL AS {kind})'}" for x, kind in PARTS.items())
            entries.append(f"IF({bucket[p]} IN ({', '.join(listed)}), named_struct('place', {p}, {', '.join(parts)}), NULL)")
        each = every.selectExpr(f"inline(array({', '.join(entries)}))").where("place IS NOT NULL")
        for r in settle(each.groupBy("place", *PARTS).agg(F.expr("count(1) AS n")).where(f"n > {limit}")).collect():
            hot[r.place].append(r)
    found = []
    for p in held:
        others = sum(r.n for r in hot[p]) < rows
        found.append(T.Row(place=p, keys=max(sizes[f"keys{p}"], len(hot[p]) + 1) if others else len(hot[p]), hot=hot[p]))
    return found


def _key_sums(is_full: str) -> list[Column]:
    return [
        F.expr("count_if(nl > 0) - sum(nl) AS more_left"),
        F.expr("count_if(nr > 0) - sum(nr) AS more_right"),
        F.expr("count_if(nl > 0 AND nr > 0) AS common"),
        F.expr(f"count_if(nl > 0 AND nr > 0 AND ({is_full})) AS full_common"),
    ]


def _is_hot(place: int, names: Sequence[str], hot: Sequence[T.Row]) -> Column:
    tests = F.lit(False)
    for p in names:
        if listed := [v[p] for v in hot if v[p] is not None]:
            tests = tests | F.coalesce(F.col(f"{p}{place}").isin(listed), F.lit(False))
    if any(all(v[p] is None for p in PARTS) for v in hot):
        absent = F.lit(True)
        for p in names:
            absent = absent & F.col(f"{p}{place}").isNull()
        tests = tests | absent
    return tests


def _home(
    typed: Sequence[DataFrame], held: Mapping[int, list[str]], sets: Mapping[int, tuple[int, ...]],
    home: int, order: Sequence[int], hot: Mapping[int, list[T.Row]], parts: int, part: tuple[int, int] = (0, 1),
) -> DataFrame | None:
    """The sums of the keys whose home is this place, of one in so many slices of its values."""
    before = order[: order.index(home)]
    mine = {}
    for i, s in sets.items():
        # A column before this one is the home unless its value is hot.
        if home in s and all(hot[p] for p in s if p in before):
            mine[i] = tuple(sorted((p for p in s if p != home), key=order.index))
    if not mine:
        return None
    used = [home, *sorted({p for s in mine.values() for p in s}, key=order.index)]
    tested = [p for p in used if p in before]
    frames = []
    own = [f"{p}{home}" for p in held[home]]
    sliced = f"pmod(xxhash64({', '.join(own)}), {part[1]}) = {part[0]}" if part[1] > 1 else "true"
    for df in typed:
        kept = df.where(sliced).where(~_is_hot(home, held[home], hot[home]))
        columns = [f"{p}{place}" for place in used for p in held[place]]
        frames.append(kept.select("side", *(_is_hot(p, held[p], hot[p]).alias(f"hot{p}") for p in tested), *columns))
    dealt = union_all(frames).repartition(parts, *own)
    fields = ", ".join(f"{c} bigint" for c in SUMS)
    count = partial(_count_part, home=home, used=used, tested=tested, held=dict(held), sets=mine)
    return dealt.mapInArrow(count, f"id int, {fields}")


def _coded(table: pa.Table, place: int, names: Sequence[str]) -> tuple[np.ndarray, int]:
    """The values of a place as numbers from 0, a missing one as the last, and how many there are."""
    codes, total = np.full(len(table), -1, dtype=np.int64), 0
    for p in names:
        encoded = table.column(f"{p}{place}").combine_chunks().dictionary_encode()
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.unify_dictionaries().combine_chunks()
        own = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.where(own >= 0, own + total, codes)
        total += len(encoded.dictionary)
    return np.where(codes < 0, total, codes), total + 1


def _count_part(
    batches: Iterator[pa.RecordBatch], home: int, used: Sequence[int], tested: Sequence[int],
    held: Mapping[int, list[str]], sets: Mapping[int, tuple[int, ...]],
) -> Iterator[pa.RecordBatch]:
    """Counts the keys of all sets in one part, column by column.

    A row alone with its values in some columns is a key of its own in every set
    that holds them, and is left out of those.
    """
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not len(table):
        return
    right = table.column("side").to_numpy() == 1
    coded = {p: _coded(table, p, held[p]) for p in used}
    is_hot = {p: table.column(f"hot{p}").to_numpy() for p in tested}
    numbers: dict[tuple[int, ...], list[int]] = {}
    for i, s in sets.items():
        numbers.setdefault(s, []).append(i)
    inner: dict[tuple[int, ...], set[int]] = {}
    for s in numbers:
        for k, p in enumerate(s):
            inner.setdefault(s[:k], set()).add(p)
    found = []

    def grow(path: tuple[int, ...], rows: np.ndarray, codes: np.ndarray, missing: np.ndarray) -> None:
        for p in sorted(inner.get(path, ())):
            at, key, absent = rows, codes, missing
            if p in is_hot:
                keep = is_hot[p][at]
                at, key, absent = at[keep], key[keep], absent[keep]
            if not len(at):
                continue
            own, many = coded[p]
            own = own[at]
            absent = absent | (own == many - 1)
            encoded = pa.array(key * many + own).dictionary_encode()
            key, total = encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)
            of_right = right[at]
            nr = np.bincount(key[of_right], minlength=total)
            often = np.bincount(key, minlength=total)
            nl = often - nr
            shared = (nl > 0) & (nr > 0)
            full = np.ones(total, dtype=bool)
            full[key[absent]] = False
            sums = (np.count_nonzero(nl) - nl.sum(), np.count_nonzero(nr) - nr.sum(), shared.sum(), (shared & full).sum())
            found.extend((i, *map(int, sums)) for i in numbers.get((*path, p), ()))
            if (*path, p) in inner:
                keep = often[key] > 1
                grow((*path, p), at[keep], key[keep], absent[keep])

    own, many = coded[home]
    grow((), np.arange(len(table)), own, own == many - 1)
    columns = list(zip(*found, strict=True)) or [()] * (1 + len(SUMS))
    kinds = [pa.int32(), *(pa.int64() for _ in SUMS)]
    arrays = [pa.array(c, type=kind) for c, kind in zip(columns, kinds, strict=True)]
    yield pa.RecordBatch.from_arrays(arrays, names=["id", *SUMS])


def _hot_sums(
    typed: Sequence[DataFrame], held: Mapping[int, list[str]], sets: Mapping[int, tuple[int, ...]],
    hot: Mapping[int, list[T.Row]], parts: int,
) -> DataFrame | None:
    """The sums of the keys all of whose values are hot."""
    mine = {i: s for i, s in sets.items() if all(hot[p] for p in s)}
    if not mine:
        return None
    used = sorted({p for s in mine.values() for p in s})
    words = range(-(-len(used) // BITS))
    frames = []
    for df in typed:
        marked = df.select("*", *(_is_hot(p, held[p], hot[p]).alias(f"hot{p}") for p in used))
        masks = (
            " + ".join(f"IF(hot{p}, {1 << (n % BITS)}L, 0L)" for n, p in enumerate(used) if n // BITS == w) for w in words
        )
        kept = (f"IF(hot{p}, {x}{p}, NULL) AS {x}{p}" for p in used for x in held[p])
        frames.append(marked.selectExpr("side", *(f"{m} AS w{w}" for w, m in enumerate(masks)), *kept))
    every = union_all(frames)
    reduced = every.groupBy(*every.columns[1:]).agg(F.expr("count_if(side = 0) AS nl"), F.expr("count_if(side = 1) AS nr"))
    structs = []
    for p in used:
        fields = (f"'{x}', {f'{x}{p}' if x in held[p] else f'CAST(NULL AS {kind})'}" for x, kind in PARTS.items())
        structs.append(f"named_struct({', '.join(fields)})")
    # Every row becomes as many keys as there are sets: it is dealt out again.
    shown = reduced.selectExpr("nl", "nr", *(f"w{w}" for w in words), f"array({', '.join(structs)}) AS held").repartition(parts)
    codes, base = set_codes(used, list(mine.values()))
    entries = []
    for (i, s), code in zip(mine.items(), codes, strict=True):
        needed = [sum(1 << (used.index(p) % BITS) for p in s if used.index(p) // BITS == w) for w in words]
        entries.append(f"named_struct('id', {i}, 'arity', {len(s)}, 'code', {code}L, {', '.join(f"'m{w}', {m}L" for w, m in enumerate(needed))})")
    taken = f"filter(array({', '.join(entries)}), e -> {' AND '.join(f'(e.m{w} & w{w}) = e.m{w}' for w in words)})"
    width = max(len(s) for s in mine.values())
    keys = shown.selectExpr("nl", "nr", "held", f"inline({taken})").selectExpr("id", "arity", "nl", "nr", *key_fields(base, width))
    counted = keys.groupBy("id", "arity", *keys.columns[4:]).agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))
    absent = (f"({width_at} < arity AND {' AND '.join(f'{p}{width_at} IS NULL' for p in PARTS)})" for width_at in range(width))
    return counted.groupBy("id").agg(*_key_sums(f"NOT ({' OR '.join(absent)})"))
