"""Exact selection and ranking by a row code, without one task per class.

A *code* is hex text that sorts the rows of a class: a seeded 128-bit hash of
the key, or an order-preserving form of the key itself; so rows with equal codes
are rows with equal keys. To find the row of rank n the
codes are counted by prefix, the prefix that holds rank n is refined, and only
when few rows are left under it are they sorted. Each step is one narrow
aggregation with map-side combine, whatever the share of a class. The result is
a handful of cut values, so that the decision "is this row among the first n"
becomes a filter on the row itself and the payload is never shuffled.
"""

from __future__ import annotations

import math
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabcascade.session import hold

LEAF_ROWS = 100_000
MAX_STEP_DIGITS = 4
#: A table of classes, targets or prefixes is broadcast up to so many rows, of at most 200 bytes.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast a counted table of classes; a larger one leaves the choice to Spark."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _prefix(depth: int) -> Column:
    return F.substring("code", 1, depth)


def _running(partition: Sequence[str], order: str) -> tuple[Column, Column]:
    """(sum of weights up to and with a row, whether it is the last row) of a window."""
    window = Window.partitionBy(*partition).orderBy(order)
    return F.sum("w").over(window), F.lead(order).over(window).isNull()


def cut_table(items: DataFrame, targets: DataFrame, sizes: DataFrame, leaf_rows: int = LEAF_ROWS, even: bool = True) -> DataFrame:
    """(label, idx, code): the code at which the running weight of a class reaches a target.

    ``items`` has ``label``, ``code`` and ``weight``; ``targets`` has ``label``, ``idx`` and ``need``; ``sizes``
    has ``label`` and ``size``, the items per class. With weight 1, unique keys and need n exactly n items
    lie at or below the cut. A need of zero or less, or above the total, has no cut. ``even`` says
    that codes are hashes; others have their common prefix skipped first.

    Any number of classes and targets: they are rows, joined to the items by label and prefix, and
    counted prefixes are summed up within the prefix above, at most 16^4 of them a window. Only the
    size of the largest rest comes to the driver.
    """
    searches = targets.where("need > 0").join(sizes, "label").select(
        "label", "idx", F.col("need").cast("double").alias("need"), F.lit("").alias("prefix"), F.col("size").alias("rows"), F.lit(1).alias("longest")
    )
    searches = hold(searches)
    depth = 0
    if not even and (searches.agg(F.max("rows")).first()[0] or 0) > leaf_rows:
        ends = items.agg(F.min("code").alias("low"), F.max("code").alias("high")).first()
        shared = os.path.commonprefix([ends["low"], ends["high"]])
        depth = len(shared)
        searches = hold(searches.withColumn("prefix", F.lit(shared)).withColumn("longest", F.lit(depth + 1)))
    while True:
        largest = searches.where(F.col("longest") > depth).agg(F.max("rows")).first()[0] or 0
        if largest <= leaf_rows:
            break
        step = min(MAX_STEP_DIGITS, math.ceil(math.log(largest / leaf_rows, 16)) or 1)
        counted = _under(items, searches, depth).groupBy("label", "prefix", _prefix(depth + step).alias("next")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.max(F.length("code")).alias("longest")
        )
        upto, last = _running(["label", "prefix"], "next")
        counted = counted.select("label", "prefix", "next", "n", "w", F.col("longest").alias("below"), upto.alias("upto"), last.alias("last"))
        found = searches.drop("longest").join(counted, ["label", "prefix"])
        before = F.col("upto") - F.col("w")
        found = found.where((before < F.col("need")) & ((F.col("need") <= F.col("upto")) | F.col("last")))
        searches = hold(found.select("label", "idx", (F.col("need") - before).alias("need"), F.col("next").alias("prefix"), F.col("n").alias("rows"), F.col("below").alias("longest")))
        depth += step
    # Few distinct items are left under each prefix: put them in order. Equal items are merged
    # first, so that many copies of one cannot pile up.
    leaf = _under(items, searches, depth).groupBy("label", "prefix", "code").agg(F.sum("weight").alias("w"))
    upto, _ = _running(["label", "prefix"], "code")
    leaf = leaf.withColumn("upto", upto)
    found = searches.join(leaf, ["label", "prefix"])
    return found.where((F.col("upto") - F.col("w") < F.col("need")) & (F.col("upto") >= F.col("need"))).select("label", "idx", "code")


def _under(items: DataFrame, searches: DataFrame, depth: int) -> DataFrame:
    """Items of the searched classes that lie under a searched prefix, with that prefix."""
    heads = small(hold(searches.select(F.col("label").alias("_label"), "prefix").distinct()))
    under = F.col("label") == F.col("_label")
    if depth:
        under = under & (_prefix(depth) == F.col("prefix"))
    return items.join(heads, under).drop("_label")


def table_of(df: DataFrame, label: str, values: Mapping | DataFrame, name: str, kind: str = "long") -> DataFrame:
    """(label, ``name``) from a dictionary by class, or such a table as it is."""
    if isinstance(values, DataFrame):
        return values
    schema = T.StructType([T.StructField("label", df.schema[label].dataType), T.StructField(name, T._parse_datatype_string(kind))])
    return df.sparkSession.createDataFrame(list(values.items()), schema)


def find_cuts(
    items: DataFrame,
    targets: Mapping[object, Sequence[float]],
    sizes: Mapping[object, int],
    leaf_rows: int = LEAF_ROWS,
    even: bool = True,
) -> dict[object, list[str | None]]:
    """The cuts of a handful of named classes, one row a target on the driver; see :func:`cut_table`."""
    wanted = table_of(items, "label", {c: [float(n) for n in needs] for c, needs in targets.items()}, "needs", "array<double>")
    wanted = wanted.select("label", F.posexplode("needs").alias("idx", "need"))
    cuts: dict[object, list[str | None]] = {label: [None] * len(needs) for label, needs in targets.items()}
    for r in cut_table(items, wanted, table_of(items, "label", sizes, "size"), leaf_rows, even).collect():
        cuts[r["label"]][r["idx"]] = r["code"]
    return cuts


def items_of(label: Column, code: Column, weight: Column | None = None) -> list[Column]:
    """The columns that :func:`find_cuts` reads."""
    weight = F.lit(1).cast("bigint") if weight is None else weight
    return [label.alias("label"), code.alias("code"), weight.alias("weight")]


def positions(
    items: DataFrame,
    largest: int,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Number the items of each class from 0 in code order, as column ``pos``.

    A class is ranked in buckets of its code's leading digits, each shifted by the size of the
    buckets before it; codes must be evenly spread hashes. The shifts have two levels: buckets are
    summed up within a bucket of buckets, and those within the class, so that no task sees all
    buckets of a class. The bucket count follows ``largest``, the size of the largest class.
    """
    digits = 0
    while largest / 16**digits > leaf_rows:
        digits += 1
    if digits == 0:
        return items.withColumn("pos", (F.row_number().over(Window.partitionBy("label").orderBy("code")) - 1).cast("bigint"))
    bucketed = items.withColumn("bucket", F.substring("code", 1, digits))
    sizes = bucketed.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    coarse = F.substring("bucket", 1, (digits + 1) // 2)
    sizes = hold(sizes.withColumn("coarse", coarse))

    def before(*partition: str) -> Column:
        order = "coarse" if partition == ("label",) else "bucket"
        window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    tops = sizes.groupBy("label", "coarse").agg(F.sum("n").alias("n")).select("label", "coarse", before("label").alias("top"))
    inner = sizes.select("label", "bucket", "coarse", before("label", "coarse").alias("inner"))
    shifts = inner.join(tops, ["label", "coarse"]).select("label", "bucket", (F.col("inner") + F.col("top")).alias("shift"))
    local = bucketed.withColumn("local", F.row_number().over(Window.partitionBy("label", "bucket").orderBy("code")) - 1)
    return (
        local.join(shifts, ["label", "bucket"])
        .withColumn("pos", (F.col("local") + F.col("shift")).cast("bigint"))
        .drop("bucket", "local", "shift")
    )
