"""Rules that fill a missing value from other columns of the same row.

Each rule touches NULLs of its target only. ``fit_*`` runs one aggregation over
the training rows and returns a few numbers; ``apply_*`` is a lazy projection
that works on any rows, streams included.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcascade.functions import half_even
from tabcascade.operators.aggregates import city_population, mean_where
from tabcascade.operators.relational import Lookup, enrich, fill_from_lookup, last_value_lookup, measured
from tabcascade.session import hold


def fill_null(df: DataFrame, target: str, candidate: Column) -> DataFrame:
    kind = df.schema[target].dataType
    return df.withColumn(target, F.coalesce(F.col(f"`{target}`"), candidate.cast(kind)))


# ---- bands and counts ---------------------------------------------------------


@dataclass(frozen=True)
class BandMeans:
    young: float | None
    middle: float | None
    senior: float | None


def band_means(value: str, young_below: float = 30, senior_from: float = 65) -> list[Column]:
    v = F.col(f"`{value}`")
    return [
        half_even(mean_where(value, v < young_below)).alias("young"),
        half_even(mean_where(value, (v >= young_below) & (v < senior_from))).alias("middle"),
        half_even(mean_where(value, v >= senior_from)).alias("senior"),
    ]


def fit_band_means(train: DataFrame, value: str, young_below: float = 30, senior_from: float = 65) -> BandMeans:
    row = train.agg(*band_means(value, young_below, senior_from)).first()
    return BandMeans(row["young"], row["middle"], row["senior"])


def apply_band_means(df: DataFrame, means: BandMeans, value: str, young_flag: str, senior_flag: str) -> DataFrame:
    young, senior = F.col(f"`{young_flag}`"), F.col(f"`{senior_flag}`")
    band = (
        F.when(young == "Yes", F.lit(means.young))
        .when(senior == "Yes", F.lit(means.senior))
        .when((young == "No") & (senior == "No"), F.lit(means.middle))
    )
    return fill_null(df, value, band)


def flagged_mean(value: str, flag: str) -> Column:
    """Rounded mean of a count among rows whose flag is Yes."""
    return half_even(mean_where(value, F.col(f"`{flag}`") == "Yes"))


def fit_flagged_mean(train: DataFrame, value: str, flag: str) -> float | None:
    return train.agg(flagged_mean(value, flag).alias("m")).first()["m"]


def apply_flagged_mean(df: DataFrame, mean: float | None, value: str, flag: str) -> DataFrame:
    yes_no = F.col(f"`{flag}`")
    return fill_null(df, value, F.when(yes_no == "Yes", F.lit(mean)).when(yes_no == "No", F.lit(0.0)))


# ---- places ---------------------------------------------------------------------


@dataclass(frozen=True)
class PlaceColumns:
    latitude: str = "Latitude"
    longitude: str = "Longitude"
    text: str = "Lat Long"
    zip_code: str = "Zip Code"
    city: str = "City"
    population: str = "Population"


def join_coordinates(df: DataFrame, c: PlaceColumns) -> DataFrame:
    """Coordinate text from its two numbers, when both are known."""
    pair = F.concat(F.col(f"`{c.latitude}`").cast("string"), F.lit(", "), F.col(f"`{c.longitude}`").cast("string"))
    return fill_null(df, c.text, pair)


def split_coordinates(df: DataFrame, c: PlaceColumns, keep_known: bool = True) -> DataFrame:
    """Numbers from the coordinate text.

    With ``keep_known=False`` a row without text loses a lone coordinate, as a
    plain overwrite does.
    """
    halves = F.split(F.col(f"`{c.text}`"), ", ", 2)
    parts = {c.latitude: F.try_element_at(halves, F.lit(1)), c.longitude: F.try_element_at(halves, F.lit(2))}
    for name, part in parts.items():
        number = part.try_cast("double")
        if keep_known:
            number = F.coalesce(number, F.col(f"`{name}`"))
        df = df.withColumn(name, number)
    return df


@dataclass(frozen=True)
class PlaceModel:
    """Dictionaries over the whole place table, measured once and used for any rows."""

    columns: PlaceColumns
    keep_known: bool
    latitude: Lookup
    longitude: Lookup
    zip_code: Lookup
    people_by_zip: Lookup | None = None
    people_by_city: Lookup | None = None
    pooled: float | None = None


def _coordinates(df: DataFrame, c: PlaceColumns, latitude: Lookup, longitude: Lookup, keep_known: bool, **how) -> DataFrame:
    df = fill_from_lookup(df, latitude, c.longitude, c.latitude, **how)
    df = fill_from_lookup(df, longitude, c.latitude, c.longitude, **how)
    return split_coordinates(join_coordinates(df, c), c, keep_known)


def fit_places(
    places: DataFrame,
    c: PlaceColumns,
    order: str,
    population: DataFrame | None = None,
    keep_known: bool = True,
    **how,
) -> PlaceModel:
    """Dictionaries between coordinates, to zip codes and to population.

    ``order`` names the column of ``places`` whose order decides which of two
    entries for one key is the later, and so the valid one.
    """
    latitude = measured(last_value_lookup(places, c.longitude, c.latitude, order), c.longitude)
    longitude = measured(last_value_lookup(places, c.latitude, c.longitude, order), c.latitude)
    known = _coordinates(places, c, latitude, longitude, keep_known, **how)
    zip_code = measured(last_value_lookup(known, c.text, c.zip_code, order), c.text)
    model = PlaceModel(c, keep_known, latitude, longitude, zip_code)
    if population is None:
        return model
    done = fill_from_lookup(known, zip_code, c.text, c.zip_code, **how)
    means = hold(city_population(done, population, c.city, c.zip_code, c.population))
    pooled = means.filter(F.col(f"`{c.city}`").isNull()).first()
    return replace(
        model,
        people_by_zip=measured(population.select(c.zip_code, c.population), c.zip_code),
        people_by_city=measured(means, c.city),
        pooled=pooled["mean_population"],
    )


def apply_places(df: DataFrame, model: PlaceModel, **how) -> DataFrame:
    """Coordinates, coordinate text and zip code; with population by zip code, else
    the mean of the city, else the mean over all, if the model has it."""
    c = model.columns
    df = _coordinates(df, c, model.latitude, model.longitude, model.keep_known, **how)
    df = fill_from_lookup(df, model.zip_code, c.text, c.zip_code, **how)
    if model.people_by_zip is None:
        return df
    df = enrich(df, model.people_by_zip, c.zip_code, **how)
    df = enrich(df, model.people_by_city, c.city, needed=F.col(f"`{c.population}`").isNull(), **how)
    without_city = F.when(F.col(f"`{c.city}`").isNull(), F.lit(model.pooled))
    filled = F.coalesce(F.col(f"`{c.population}`").cast("double"), F.col("mean_population"), without_city)
    return df.withColumn(c.population, filled).drop("mean_population")


# ---- yes/no services --------------------------------------------------------------


@dataclass(frozen=True)
class ServiceColumns:
    phone: str = "Phone Service"
    lines: str = "Multiple Lines"
    internet: str = "Internet Service"
    internet_type: str = "Internet Type"
    download: str = "Avg Monthly GB Download"
    extras: Sequence[str] = (
        "Online Security",
        "Online Backup",
        "Device Protection Plan",
        "Premium Tech Support",
        "Streaming TV",
        "Streaming Movies",
        "Streaming Music",
        "Unlimited Data",
    )
    wired: Sequence[str] = ("Cable", "DSL", "Fiber Optic")


def phone_rules(df: DataFrame, c: ServiceColumns) -> DataFrame:
    df = fill_null(df, c.phone, F.when(F.col(f"`{c.lines}`") == "Yes", F.lit("Yes")))
    return fill_null(df, c.lines, F.when(F.col(f"`{c.phone}`") == "No", F.lit("No")))


def internet_from_type(df: DataFrame, c: ServiceColumns) -> DataFrame:
    return fill_null(df, c.internet, F.when(F.col(f"`{c.internet_type}`").isin(*c.wired), F.lit("Yes")))


def internet_from_download(df: DataFrame, c: ServiceColumns) -> DataFrame:
    return fill_null(df, c.internet, F.when(F.col(f"`{c.download}`") > 0, F.lit("Yes")))


def internet_from_extras(df: DataFrame, c: ServiceColumns) -> DataFrame:
    any_yes = F.greatest(*[(F.col(f"`{x}`") == "Yes").cast("int") for x in c.extras])
    return fill_null(df, c.internet, F.when(any_yes == 1, F.lit("Yes")))


def type_without_internet(df: DataFrame, c: ServiceColumns) -> DataFrame:
    return fill_null(df, c.internet_type, F.when(F.col(f"`{c.internet}`") == "No", F.lit("None")))


def download_without_internet(df: DataFrame, c: ServiceColumns) -> DataFrame:
    return fill_null(df, c.download, F.when(F.col(f"`{c.internet}`") == "No", F.lit(0)))


def extras_without_internet(df: DataFrame, c: ServiceColumns, compat: bool = False) -> DataFrame:
    """An extra is No where there is no internet service.

    ``compat=True`` reproduces stored results of a chain that wrote each extra
    over the service column instead, one after the other, which leaves the last
    extra there when it is known, and otherwise No only if the chain was at No.
    """
    if not compat:
        off = F.when(F.col(f"`{c.internet}`") == "No", F.lit("No"))
        return df.withColumns({x: F.coalesce(F.col(f"`{x}`"), off) for x in c.extras})
    for extra in c.extras:
        df = df.withColumn(
            c.internet,
            F.coalesce(F.col(f"`{extra}`"), F.when(F.col(f"`{c.internet}`") == "No", F.lit("No"))),
        )
    return df


def service_rules(df: DataFrame, c: ServiceColumns, compat: bool = False) -> DataFrame:
    df = phone_rules(df, c)
    df = internet_from_extras(internet_from_download(internet_from_type(df, c), c), c)
    df = download_without_internet(type_without_internet(df, c), c)
    return extras_without_internet(df, c, compat)
