"""Column helpers. Everything here is a built-in expression, so it stays in codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = str | Column

# The words a CSV reader of the pandas 1.3 line takes as missing.
# The word "None" is not among them and stays a category of its own.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
)


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: ColumnLike, scale: int = 0) -> Column:
    """Round half to even, the way a Python ``round`` does."""
    return F.bround(_col(c), scale)


def quotient(top: ColumnLike, bottom: ColumnLike) -> Column:
    """``top / bottom``, NULL where the divisor is zero or a side is missing."""
    return _col(top) / F.nullif(_col(bottom).cast("double"), F.lit(0.0))


def ceil_quotient(top: ColumnLike, bottom: ColumnLike) -> Column:
    return F.ceil(quotient(top, bottom)).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NULL the only kind of missing value; ``NaN > 0`` is true in Spark."""
    floating = {
        f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floating) if floating else df


def tokens_to_null(c: ColumnLike, tokens: Iterable[str] = MISSING_TOKENS) -> Column:
    c = _col(c)
    return F.when(~F.trim(c).isin(*tokens), c)


def binary_label(label: ColumnLike, base: int = 0) -> Column:
    """0 for the base class, 1 for every other class."""
    return F.when(_col(label) == base, 0).otherwise(1).cast("int")


def shift_label(label: ColumnLike, by: int) -> Column:
    """Move between the label space of all rows and that of the second stage."""
    return (_col(label) + F.lit(by)).cast("int")


def code_label(text: ColumnLike, codes: Mapping[str, int], missing: int = -1) -> Column:
    """Category text to code; a missing text gets ``missing``, an unknown one NULL."""
    text = _col(text)
    coded = F.when(text.isNull(), F.lit(missing))
    for name, code in codes.items():
        coded = coded.when(text == name, F.lit(code))
    return coded.cast("int")


def decode_label(code: ColumnLike, codes: Mapping[str, int]) -> Column:
    """The inverse of :func:`code_label`; unknown codes and the missing code give NULL."""
    code = _col(code)
    text = F.lit(None).cast("string")
    for name, value in codes.items():
        text = F.when(code == value, F.lit(name)).otherwise(text)
    return text


def seeded_code(seed: int | str, *keys: ColumnLike) -> Column:
    """32 hex digits that depend on the seed and the row key only.

    Unlike ``rand`` the value survives a repartition, a retry and a change of
    cluster size, and any SQL engine with ``md5`` can recompute it.
    """
    parts = [F.lit(str(seed))] + [_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def draw_number(code: Column, below: ColumnLike) -> Column:
    """A number in ``[0, below)`` from the first 60 bits of a hex code."""
    number = F.conv(F.substring(code, 1, 15), 16, 10).cast("bigint")
    return number % _col(below).cast("bigint")


def order_code(df: DataFrame, name: str) -> Column:
    """Hex text that sorts like the column: integers and strings."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.hex(c)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.lpad(F.hex(c.cast("bigint").bitwiseXOR(F.lit(-(2**63)).cast("bigint"))), 16, "0")
    raise TypeError(f"cannot order rows by column {name} of type {kind.simpleString()}")
