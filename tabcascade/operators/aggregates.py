"""Audits, statistics, counts and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcascade.functions import half_even


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: how many values are missing, out of how many rows."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"_{i}") for i, c in enumerate(columns)],
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_null")) for i, c in enumerate(columns)])
    return counts.select(F.explode(cells).alias("cell"), "n_rows").select("cell.column_name", "cell.n_null", "n_rows")


def total_nulls(df: DataFrame, columns: Sequence[str], name: str = "n_null") -> DataFrame:
    per_row = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("bigint") for c in columns])
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("bigint").alias(name))


def mean_where(value: str, condition: Column) -> Column:
    return F.avg(F.when(condition, F.col(f"`{value}`")))


def rounded_mean(value: str, condition: Column | None = None) -> Column:
    """Mean rounded half to even, over all rows or over those that meet a condition."""
    return half_even(F.avg(F.col(f"`{value}`")) if condition is None else mean_where(value, condition))


def value_counts(df: DataFrame, by: str | Sequence[str], name: str = "n") -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def class_table(df: DataFrame, label: str) -> DataFrame:
    """(label, size): one row per class; rows without a label are left out."""
    known = df.filter(F.col(f"`{label}`").isNotNull())
    return known.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count(F.lit(1)).alias("size"))


def modes(df: DataFrame, numbers: Sequence[str] = (), texts: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per column, the smallest on ties.

    Columns in ``numbers`` compare as numbers, those in ``texts`` as text. All
    values are counted in long form, so that no task holds the distinct values
    of a whole column, which a built-in ``mode`` aggregate would.
    """
    none = {"double": F.lit(None).cast("double"), "string": F.lit(None).cast("string")}
    cells = [(c, F.col(f"`{c}`").cast("double"), none["string"]) for c in numbers]
    cells += [(c, none["double"], F.col(f"`{c}`").cast("string")) for c in texts]
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), n.alias("number"), t.alias("text")) for c, n, t in cells])).alias("cell")
    ).select("cell.*")
    known = long.filter(F.col("number").isNotNull() | F.col("text").isNotNull())
    counted = known.groupBy("column_name", "number", "text").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("number", "text"), F.struct(-F.col("n"), F.col("number"), F.col("text")))
    return (
        counted.groupBy("column_name").agg(best.alias("best"), F.max("n").alias("n"))
        .select("column_name", F.col("best.number").alias("number"), F.col("best.text").alias("text"), "n")
    )


def spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample standard deviation, minimum and maximum per column, in one pass."""
    parts = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double")
        parts += [
            F.avg(v).alias(f"mean_{i}"),
            F.stddev_samp(v).alias(f"std_{i}"),
            F.min(v).alias(f"min_{i}"),
            F.max(v).alias(f"max_{i}"),
        ]
    one = df.agg(*parts)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                *[F.col(f"{s}_{i}").alias(f"{s}_value") for s in ("mean", "std", "min", "max")],
            )
            for i, c in enumerate(columns)
        ]
    )
    return one.select(F.explode(cells).alias("cell")).select("cell.*")


def city_population(places: DataFrame, population: DataFrame, city: str, zip_code: str, people: str) -> DataFrame:
    """Mean population per city over its distinct zip codes, and over all cities.

    A zip code that two cities share counts in both. A city without a known zip
    code gets 0. The row with a NULL city is the pooled mean over all (city,
    zip) pairs and serves rows whose city is missing too.
    """
    pairs = places.select(city, zip_code).filter(F.col(f"`{city}`").isNotNull()).distinct()
    # One zip code may hold a large share of the places, but not of the distinct
    # pairs: it occurs there once per city.
    known = pairs.join(population.select(zip_code, people), zip_code, "left")
    per_city = known.groupBy(city).agg(
        F.coalesce(F.sum(people).cast("double"), F.lit(0.0)).alias("_people"), F.count(people).alias("_zips")
    )
    means = per_city.select(
        F.col(f"`{city}`"),
        half_even(F.when(F.col("_zips") > 0, F.col("_people") / F.col("_zips")).otherwise(0.0)).alias("mean_population"),
    )
    pooled = per_city.agg(half_even(F.sum("_people") / F.nullif(F.sum("_zips"), F.lit(0))).alias("mean_population"))
    return means.unionByName(pooled.withColumn(city, F.lit(None).cast(places.schema[city].dataType)))


def confidence_histogram(
    df: DataFrame,
    fold: str,
    label: str,
    prediction: str,
    confidence: str,
    low: float = 0.5,
    high: float = 1.0,
    bins: int = 49,
    below: float = 0.9,
) -> DataFrame:
    """Counts of correct and wrong predictions per fold and confidence bin."""
    unsure = df.filter(F.col(f"`{confidence}`") < below)
    return (
        unsure.select(
            F.col(f"`{fold}`"),
            (F.col(f"`{prediction}`") == F.col(f"`{label}`")).alias("correct"),
            F.expr(f"width_bucket(`{confidence}`, {low}D, {high}D, {bins})").cast("int").alias("bin"),
        )
        .groupBy(fold, "correct", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_k(df: DataFrame, score: str, name: str, k: int) -> DataFrame:
    """The k best rows of a report; ties go to the smaller name."""
    return df.orderBy(F.col(f"`{score}`").desc(), F.col(f"`{name}`").asc()).limit(k)


def best_by_mean(scores: DataFrame, setting: str, score: str) -> DataFrame:
    """The setting with the best mean fold score; ties go to the smaller setting."""
    means = scores.groupBy(setting).agg(F.avg(score).alias("mean_score"))
    return means.orderBy(F.col("mean_score").desc(), F.col(setting).asc()).limit(1)


def row_confidence(probabilities: Sequence[str]) -> Column:
    """Largest class probability of a row."""
    return F.greatest(*[F.col(f"`{p}`") for p in probabilities])
