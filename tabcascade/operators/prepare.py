"""Fill, encode and scale. Statistics come from training rows and fit on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcascade.functions import half_even, quotient, seeded_code
from tabcascade.operators.aggregates import modes
from tabcascade.operators.relational import enrich
from tabcascade.operators.selection import LEAF_ROWS, positions
from tabcascade.session import hold

MAX_LEVELS = 10_000


def _each(df: DataFrame, parts: dict[str, Column]) -> dict:
    """Run one aggregation; values by name. One row, as wide as the column list."""
    if not parts:
        return {}
    names = list(parts)
    row = df.agg(*[parts[n].alias(f"_{i}") for i, n in enumerate(names)]).first()
    return {n: row[i] for i, n in enumerate(names)}


# ---- fill -----------------------------------------------------------------------


@dataclass(frozen=True)
class FillSpec:
    rounded_mean: Sequence[str] = ()
    mean: Sequence[str] = ()
    zero: Sequence[str] = ()
    mode: Sequence[str] = ()
    # Mode counted and compared as text, also for numbers.
    mode_text: Sequence[str] = ()


def fit_fill(train: DataFrame, spec: FillSpec) -> dict:
    """Fill value per column: one job for the means, one for the modes."""
    values = _each(
        train,
        {c: half_even(F.avg(F.col(f"`{c}`"))) for c in spec.rounded_mean}
        | {c: F.avg(F.col(f"`{c}`")) for c in spec.mean},
    )
    values |= {c: 0.0 for c in spec.zero}
    if spec.mode or spec.mode_text:
        found = modes(train, spec.mode, spec.mode_text).collect()
        values |= {r["column_name"]: r["number"] if r["text"] is None else r["text"] for r in found}
    return values


def apply_fill(df: DataFrame, values: Mapping) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    filled = {
        c: F.coalesce(F.col(f"`{c}`"), F.lit(v).cast(kinds[c]))
        for c, v in values.items()
        if v is not None and c in kinds
    }
    return df.withColumns(filled) if filled else df


# ---- one-hot --------------------------------------------------------------------


def _level_rows(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    return train.select(F.explode(cells).alias("cell")).select("cell.*").filter(F.col("value").isNotNull()).distinct()


def fit_levels(train: DataFrame, columns: Sequence[str], most: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Distinct values per categorical column, sorted: one named column each later on.

    A column of more than ``most`` values is refused; :func:`fit_level_table` takes any number.
    """
    pairs = _level_rows(train, columns)
    counts = {r["column_name"]: r["n"] for r in pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = [c for c, n in counts.items() if n > most]
    if wide:
        raise ValueError(f"more than {most} category values in {wide}: encode them by a level table")
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for r in pairs.collect():
        levels[r["column_name"]].append(r["value"])
    return {c: sorted(v) for c, v in levels.items()}


@dataclass(frozen=True)
class LevelTable:
    """(column_name, value, index) of all levels, numbered from 0 in each column; levels per column."""

    rows: DataFrame
    sizes: Mapping[str, int]


def fit_level_table(train: DataFrame, columns: Sequence[str], leaf_rows: int = LEAF_ROWS) -> LevelTable:
    """The level dictionary as a table, for any number of values.

    Levels are numbered in the order of a hash, in buckets, so that no task holds a whole column.
    """
    pairs = hold(_level_rows(train, columns))
    counts = {r["column_name"]: r["n"] for r in pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {c: counts.get(c, 0) for c in columns}
    items = pairs.select(F.col("column_name").alias("label"), seeded_code("level", "value").alias("code"), "value")
    ranked = positions(items, max(sizes.values(), default=0), leaf_rows)
    return LevelTable(hold(ranked.select(F.col("label").alias("column_name"), "value", F.col("pos").alias("index"))), sizes)


def encode_levels(df: DataFrame, levels: LevelTable, out: str = "encoded", row_key: str | None = None, **how) -> DataFrame:
    """One sparse 0/1 vector over the levels of all columns, in the order of the table's columns.

    A value becomes its number by an index join, a missing or unseen one the number behind the
    last, which the encoder drops: zeros. The columns themselves stay; a column without any level
    takes no place.
    """
    columns = [c for c, n in levels.sizes.items() if n]
    if not columns:
        return df.withColumn(out, array_to_vector(F.array().cast("array<double>")))
    coded = df
    for k, c in enumerate(columns):
        own = levels.rows.where(F.col("column_name") == c).select(F.col("value").alias("_value"), F.col("index").alias(f"_index{k}"))
        coded = enrich(coded.withColumn("_value", F.col(f"`{c}`").cast("string")), own, "_value", row_key=row_key, **how).drop("_value")
        told = {"ml_attr": {"type": "nominal", "num_vals": levels.sizes[c] + 1, "name": c}}
        number = F.coalesce(F.col(f"_index{k}"), F.lit(levels.sizes[c])).cast("double")
        coded = coded.withColumn(f"_index{k}", number.alias(f"_index{k}", metadata=told))
    numbers, flags = [f"_index{k}" for k in range(len(columns))], [f"_flags{k}" for k in range(len(columns))]
    encoder = OneHotEncoder(inputCols=numbers, outputCols=flags, dropLast=True, handleInvalid="error").fit(coded)
    packed = VectorAssembler(inputCols=flags, outputCol=out).transform(encoder.transform(coded))
    return packed.select(*[F.col(f"`{c}`") for c in df.columns], out)


def apply_one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]], sep: str = "_") -> DataFrame:
    """One 0/1 column per level seen in training; a missing or unseen value gives zeros.

    Both frames get the same columns because the levels are fixed beforehand.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in levels]
    flags = [
        F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}{sep}{v}")
        for c, values in levels.items()
        for v in values
    ]
    return df.select(*kept, *flags)


# ---- scale ----------------------------------------------------------------------


@dataclass(frozen=True)
class Scaling:
    """``(x - offset) / unit`` per column."""

    offset: Mapping[str, float] = field(default_factory=dict)
    unit: Mapping[str, float] = field(default_factory=dict)


def fit_scalings(train: DataFrame, columns: Sequence[str]) -> dict[str, Scaling]:
    """Z-score (``std``) and range (``minmax``) scaling, from one pass."""
    wanted = {}
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        wanted |= {("m", c): F.avg(v), ("s", c): F.stddev_samp(v), ("l", c): F.min(v), ("h", c): F.max(v)}
    got = _each(train, wanted)
    low = {c: got["l", c] for c in columns}
    return {
        "std": Scaling({c: got["m", c] for c in columns}, {c: got["s", c] for c in columns}),
        "minmax": Scaling(low, {c: None if low[c] is None else got["h", c] - low[c] for c in columns}),
    }


def fit_standard(train: DataFrame, columns: Sequence[str]) -> Scaling:
    return fit_scalings(train, columns)["std"]


def fit_min_max(train: DataFrame, columns: Sequence[str]) -> Scaling:
    return fit_scalings(train, columns)["minmax"]


def apply_scaling(df: DataFrame, scaling: Scaling) -> DataFrame:
    """Scaled columns; a column without spread becomes NULL rather than infinite."""
    return df.withColumns(
        {
            c: quotient(F.col(f"`{c}`").cast("double") - F.lit(scaling.offset[c]), F.lit(scaling.unit[c]).cast("double"))
            for c in scaling.offset
        }
    )


# ---- polynomial features ----------------------------------------------------------


def polynomial(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Degree-two terms next to the columns: ``a^2`` and ``a b``."""
    terms = {
        (f"{a}^2" if a == b else f"{a} {b}"): F.col(f"`{a}`") * F.col(f"`{b}`")
        for a, b in combinations_with_replacement(columns, 2)
    }
    return df.withColumns(terms)
