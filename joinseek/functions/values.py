"""Column values as join keys, as SQL text: what is missing, what is equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

from joinseek.session import quoted

FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_missing(name: str, dtype: T.DataType) -> str:
    """Null, or NaN in a floating-point column."""
    value = quoted(name)
    if isinstance(dtype, FRACTIONAL):
        return f"({value} IS NULL OR isnan({value}))"
    return f"({value} IS NULL)"


def _is_whole(value: str) -> str:
    """True if a double is a whole number a bigint holds."""
    return f"(rint({value}) = {value} AND {value} >= -9223372036854775808D AND {value} < 9223372036854775808D)"


def _double_key(value: str) -> str:
    return (
        f"CASE WHEN isnan({value}) THEN NULL WHEN {_is_whole(value)} THEN CAST(try_cast({value} AS BIGINT) AS STRING) "
        f"ELSE CAST({value} AS STRING) END"
    )


def _decimal_key(value: str, dtype: T.DecimalType) -> str:
    own, as_double = dtype.simpleString(), f"CAST({value} AS DOUBLE)"
    whole = f"try_cast({value} AS BIGINT)"
    return (
        f"CASE WHEN try_cast({whole} AS {own}) = {value} THEN CAST({whole} AS STRING) "
        f"WHEN try_cast({as_double} AS {own}) = {value} THEN {_double_key(as_double)} "
        f"ELSE rtrim('0', CAST({value} AS STRING)) END"
    )


def join_key(name: str, dtype: T.DataType) -> str:
    """The value as a string such that equal values give equal strings.

    Numbers compare by value across all numeric types (3, 3.0 and -0.0 = 0).
    Strings stay raw, so dates given as strings compare as written; a native
    timestamp at midnight equals its date. Missing values give null.
    """
    value = quoted(name)
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, FRACTIONAL):
        return _double_key(f"CAST({value} AS DOUBLE)")
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return _decimal_key(value, dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        day = f"CAST({value} AS DATE)"
        midnight = f"CAST({day} AS {dtype.simpleString()})"
        return f"IF({midnight} = {value}, CAST({day} AS STRING), CAST({value} AS STRING))"
    if isinstance(dtype, T.BinaryType):
        return f"base64({value})"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({value})"
    return f"CAST({value} AS STRING)"


# The parts a key value may use, with their types. Whole numbers go in ``l`` even
# if their column is fractional, so numbers meet across types without a cast to
# text; everything else is text in ``s``.
PARTS = {"l": "BIGINT", "d": "DOUBLE", "s": "STRING"}


def needs_text(dtype: T.DataType) -> bool:
    """True for numbers that neither a bigint nor a double holds exactly."""
    return isinstance(dtype, T.DecimalType) and (dtype.scale > 0 or dtype.precision > 18)


LONG_BYTES = 64


def _compact(value: str) -> str:
    """Long text as its SHA-256 and length, which no short text can equal.

    The digest covers the whole text, so equal keys still mean equal values,
    while documents do not travel through the shuffle.
    """
    digest = f"concat(sha2({value}, 256), ':', length({value}))"
    return f"IF(octet_length({value}) <= {LONG_BYTES}, {value}, {digest})"


def key_parts(name: str, dtype: T.DataType, as_text: bool = False) -> dict[str, str]:
    """The value as one or two typed parts of which at most one is not null.

    Two columns of equal category have equal parts exactly for equal values, if
    both or neither are taken ``as_text``. All parts are null if it is missing.
    """
    value = quoted(name)
    if isinstance(dtype, T.NumericType) and not as_text and not needs_text(dtype):
        if not isinstance(dtype, FRACTIONAL):
            return {"l": f"CAST({value} AS BIGINT)"}
        number = f"CAST({value} AS DOUBLE)"
        whole = _is_whole(number)
        return {
            "l": f"IF({whole}, try_cast({number} AS BIGINT), NULL)",
            "d": f"IF({whole} OR isnan({number}), NULL, {number})",
        }
    key = join_key(name, dtype)
    free_text = isinstance(dtype, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
    return {"s": _compact(key) if free_text else key}


def typed_values(schema: T.StructType, names: Sequence[str]) -> list[str]:
    """The columns as structs of one type, SQL text."""
    values = []
    for name in names:
        parts = key_parts(name, schema[name].dataType)
        fields = (f"'{p}', {parts.get(p, f'CAST(NULL AS {kind})')}" for p, kind in PARTS.items())
        values.append(f"named_struct({', '.join(fields)})")
    return values


def set_codes(names: Sequence[str], sets: Sequence[Sequence[str]]) -> tuple[list[int], int]:
    """One number per column set, whose digits name its columns, and their base."""
    place = {c: i + 1 for i, c in enumerate(names)}
    base = len(names) + 1
    return [sum(place[c] * base**i for i, c in enumerate(columns)) for columns in sets], base


def key_fields(base: int, width: int) -> list[str]:
    """The key a ``code`` names, out of the array ``held`` of typed values."""
    digits = (f"CAST(code div {base**i} % {base} AS INT) - 1" for i in range(width))
    return [f"get(held, {digit}).{p} AS {p}{i}" for i, digit in enumerate(digits) for p in PARTS]
