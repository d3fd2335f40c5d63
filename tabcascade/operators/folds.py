"""Fold numbers for cross-validation, as a column of the rows.

Stratified folds are consecutive stretches of a class in code order, so k - 1
cut values per class describe them, which are joined by label: no ranking of all
rows, and with few classes no shuffle of the payload.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabcascade.functions import order_code, seeded_code
from tabcascade.operators.aggregates import class_table
from tabcascade.operators.relational import Lookup, enrich, measured_bytes
from tabcascade.operators.selection import LEAF_ROWS, cut_table, items_of, positions
from tabcascade.session import hold


def fold_shares(sizes: Mapping[object, int], k: int) -> dict[object, list[int]]:
    """Rows of each class per fold.

    Labels laid out one class after the other are dealt to the folds in turn,
    so that both the folds and the classes within them differ by at most one.
    """
    shares, start = {}, 0
    for label in sorted(sizes):
        end = start + sizes[label]
        shares[label] = [(end - i + k - 1) // k - (start - i + k - 1) // k for i in range(k)]
        start = end
    return shares


def _fold_ends(sizes: DataFrame, k: int) -> DataFrame:
    """(label, idx, need): rows of each class in the first idx + 1 folds, by :func:`fold_shares`."""
    start = F.sum("size").over(Window.orderBy("label")) - F.col("size")  # one row a class
    dealt = f"aggregate(sequence(0, idx), 0L, (a, i) -> a + (start + size - i + {k - 1}) div {k} - (start - i + {k - 1}) div {k})"
    return sizes.withColumn("start", start).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 2))).alias("idx")).select("label", "idx", F.expr(dealt).alias("need"))


def stratified_folds(
    df: DataFrame,
    key: str,
    label: str,
    k: int,
    seed: int | None = None,
    name: str = "fold",
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Stratified k-fold over unique keys: in key order, or shuffled by a seed.

    A class has k - 1 cut values; a row's fold is the number of them below its code. Rows without
    a label get no fold.
    """
    code = order_code(df, key) if seed is None else seeded_code(seed, key)
    lab = F.col(f"`{label}`")
    if k < 2:
        return df.withColumn(name, F.when(lab.isNotNull(), F.lit(0)))
    sizes = hold(class_table(df, label))
    items = df.filter(lab.isNotNull()).select(*items_of(lab, code))
    cuts = cut_table(items, _fold_ends(sizes, k), sizes, leaf_rows, even=seed is not None)
    per_class = sizes.select("label").join(cuts.groupBy("label").agg(F.collect_list("code").alias("codes")), "label", "left")
    per_class = per_class.select(F.col("label").alias(label), F.coalesce("codes", F.array().cast("array<string>")).alias("_cuts"))
    placed = enrich(df, per_class, label, row_key=key).withColumn("_code", code)
    # a class without rows in the first folds has no cut there
    fold = F.lit(k - 1) - F.size("_cuts") + F.size(F.filter("_cuts", lambda c: F.col("_code") > c))
    return placed.withColumn(name, F.when(F.col("_cuts").isNotNull(), fold).cast("int")).select(*df.columns, name)


def _deals(histogram: DataFrame, k: int) -> DataFrame:
    """(label, weight, deal): the folds in the order in which groups of a weight are dealt.

    Largest weights first; equal groups go round the folds, beginning with the emptiest of their
    class (first of equals: a turn that depends on the label). A class has about the square root
    of twice its rows of different weights at most.
    """

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        loads, out = [0] * k, []
        for weight, n, turn in sorted(zip(rows["weight"], rows["n"], rows["turn"], strict=True), reverse=True):
            order = sorted(range(k), key=lambda i: (loads[i], (i - turn) % k))
            full, rest = divmod(int(n), k)
            for place, i in enumerate(order):
                loads[i] += (full + (place < rest)) * int(weight)
            out.append(order)
        rows = rows.sort_values("weight", ascending=False).drop(columns="turn")
        return rows.assign(deal=out)[["label", "weight", "deal"]]

    turn = F.conv(F.substring(F.md5(F.col("label").cast("string")), 1, 8), 16, 10).cast("long") % k
    kind = histogram.schema["label"].dataType.simpleString()
    turned = histogram.withColumn("turn", F.coalesce(turn, F.lit(0)))
    return turned.groupBy("label").applyInPandas(deal, f"label {kind}, weight long, deal array<int>")


def group_folds(
    df: DataFrame,
    group: str,
    label: str,
    k: int,
    seed: int = 0,
    name: str = "fold",
    leaf_rows: int = LEAF_ROWS,
    **how,
) -> DataFrame:
    """Stratified group k-fold: no group is in two folds, classes stay in proportion.

    A group belongs to its most frequent known label, the smallest on ties; groups without any
    known label are a class of their own, and rows without a group are one group. Its weight is
    its number of rows. Within a class the heaviest groups go first, each to the emptiest fold;
    groups of one weight are dealt in turn, in hash order, so that the rule needs the histogram
    of weights only. ``how`` goes to the join of the folds to the rows.
    """
    lab = F.col(f"`{label}`").alias("label")
    code = seeded_code(seed, group)
    pairs = df.groupBy(code.alias("code"), lab).agg(F.count(F.lit(1)).alias("n"))
    groups = pairs.groupBy("code").agg(
        F.min_by("label", F.struct(F.col("label").isNull(), -F.col("n"), "label")).alias("label"),
        F.sum("n").alias("weight"),
    )
    groups = hold(groups)
    histogram = hold(groups.groupBy("label", "weight").agg(F.count(F.lit(1)).alias("n")))
    largest = histogram.agg(F.max("n")).first()[0]
    if largest is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    equal = F.concat_ws(":", F.coalesce(F.col("label").cast("string"), F.lit("")), F.col("label").isNull().cast("string"), "weight")
    ranked = positions(groups.select(equal.alias("label"), "code", F.col("label").alias("class"), "weight"), largest, leaf_rows)
    deals = _deals(histogram, k).withColumnsRenamed({"label": "_class", "weight": "_weight"})
    dealt = ranked.join(deals, F.col("class").eqNullSafe(F.col("_class")) & (F.col("weight") == F.col("_weight")))
    folds = dealt.select(F.col("code").alias("_group"), F.element_at("deal", (F.col("pos") % k + 1).cast("int")).alias(name))
    folds = hold(folds.where("_group IS NOT NULL"))  # one row a group, as they were grouped
    placed = enrich(df.withColumn("_group", code), Lookup(folds, "_group", measured_bytes(folds)), "_group", **how)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], name)
