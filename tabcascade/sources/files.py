"""CSV in, CSV and Parquet out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabcascade.functions import nan_to_null, tokens_to_null


def _schema(text: Sequence[str], numbers: Sequence[str]) -> T.StructType:
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in text] + [T.StructField(c, T.DoubleType()) for c in numbers]
    )


# The raw tables and their columns.
SCHEMAS = {
    "demographics": _schema(
        ["Customer ID", "Gender", "Under 30", "Senior Citizen", "Married", "Dependents"],
        ["Count", "Age", "Number of Dependents"],
    ),
    "location": _schema(
        ["Customer ID", "Country", "State", "City", "Lat Long"],
        ["Count", "Zip Code", "Latitude", "Longitude"],
    ),
    "population": _schema([], ["ID", "Zip Code", "Population"]),
    "services": _schema(
        [
            "Customer ID", "Quarter", "Referred a Friend", "Offer", "Phone Service", "Multiple Lines",
            "Internet Service", "Internet Type", "Online Security", "Online Backup",
            "Device Protection Plan", "Premium Tech Support", "Streaming TV", "Streaming Movies",
            "Streaming Music", "Unlimited Data", "Contract", "Paperless Billing", "Payment Method",
        ],
        [
            "Count", "Number of Referrals", "Tenure in Months", "Avg Monthly Long Distance Charges",
            "Avg Monthly GB Download", "Monthly Charge", "Total Charges", "Total Refunds",
            "Total Extra Data Charges", "Total Long Distance Charges", "Total Revenue",
        ],
    ),
    "satisfaction": _schema(["Customer ID"], ["Satisfaction Score"]),
    "status": _schema(["Customer ID", "Churn Category"], []),
    "ids": _schema(["Customer ID"], []),
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, drop: Sequence[str] = (), multi_line: bool = False) -> DataFrame:
    """Read a CSV with a header; the usual words for "missing" become NULL.

    Columns are matched by header name; a declared one that the header does not have is an error, as is
    a value that is neither missing nor of the declared type. A quoted value may hold line breaks
    with ``multi_line``, for which each file is read by one task.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    kinds = {f.name: f.dataType for f in schema.fields if f.name not in set(drop)}
    lost = [c for c in kinds if c not in raw.columns]
    if lost:
        raise ValueError(f"{path}: the header has no {lost}")
    typed = raw.select(
        *[
            tokens_to_null(F.col(f"`{c}`")).cast(kinds[c]).alias(c)
            for c in raw.columns
            if c in kinds
        ]
    )
    return nan_to_null(typed)


def read_labels(spark: SparkSession, path: str, key: str, label: str) -> DataFrame:
    """A prediction file: key and integer label."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(label, T.IntegerType())])
    return read_csv(spark, path, schema)


def write_submission(df: DataFrame, path: str, key: str, label: str) -> None:
    """Two columns with a header; one file per partition, no single-task merge."""
    out = df.select(F.col(f"`{key}`"), F.col(f"`{label}`").cast("int").alias(label))
    out.write.mode("overwrite").option("header", True).csv(path)


def write_clean(df: DataFrame, folder: str, part: str, norm: str, kind: str = "parquet") -> str:
    """Store a cleaned table under ``part=.../norm=...`` and return its folder."""
    path = f"{folder}/part={part}/norm={norm}"
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
    return path


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Store an entity table bucketed and sorted by its key.

    Tables with equal bucket counts are joined on the key without a shuffle.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
