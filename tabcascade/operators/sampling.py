"""Deterministic class balancing.

Choice is by a seeded hash of the row key: exact counts, repeatable on any
cluster, and recomputable in SQL. Copies carry the key, so a fold assigned by
key keeps all copies of a row together. Keys must be unique within the input.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabcascade.functions import draw_number, seeded_code
from tabcascade.operators.aggregates import class_table
from tabcascade.operators.relational import enrich
from tabcascade.operators.selection import (
    LEAF_ROWS,
    cut_table,
    items_of,
    positions,
    small,
    table_of,
)
from tabcascade.session import hold

COPY = "draw"
COPIES_PER_TASK_ROW = 10_000
#: Draws that one row of the plan stands for before it is unfolded.
DRAWS_PER_ROW = 100_000

#: What to do per class: a dictionary, or a table (label, n) of any number of classes.
Plan = Mapping[object, int] | DataFrame


def _labels(df: DataFrame, label: str, table: DataFrame) -> DataFrame:
    """Rows whose class is in ``table``."""
    return df.join(small(table.select(F.col("label").alias("_class"))), F.col(f"`{label}`") == F.col("_class"), "left_semi")


def keep_exactly(
    df: DataFrame,
    key: str,
    label: str,
    sizes: Plan,
    seed: int,
    have: DataFrame | None = None,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Of each class in ``sizes`` keep exactly that many rows (all, if it has fewer).

    Rows of other classes stay. Each class has one cut value, which is joined by label; with few
    classes nothing is shuffled but counts. ``have``, the present class sizes, saves one of them.
    """
    code, lab = seeded_code(seed, key), F.col(f"`{label}`")
    have = hold(class_table(df, label)) if have is None else have
    shrunk = hold(table_of(df, label, sizes, "n").join(have, "label").where("n < size"))
    if shrunk.isEmpty():
        return df
    items = _labels(df, label, shrunk).select(*items_of(lab, code))
    cuts = cut_table(items, shrunk.select("label", F.lit(0).alias("idx"), F.col("n").alias("need")), have, leaf_rows)
    last = shrunk.select("label").join(cuts.drop("idx"), "label", "left")
    last = last.select(F.col("label").alias(label), F.coalesce("code", F.lit("")).alias("_last"))
    cut = enrich(df, last, label, row_key=key)
    return cut.filter(F.col("_last").isNull() | (code <= F.col("_last"))).select(*[F.col(f"`{c}`") for c in df.columns])


def extra_draws(
    df: DataFrame,
    key: str,
    label: str,
    draws: Plan,
    seed: int,
    sizes: DataFrame | None = None,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Rows of each class drawn with replacement, ``draws[class]`` of them.

    Draw ``d`` of a class takes the row at position ``hash(seed, class, d)``
    modulo the class size. Draws are unfolded from the plan in many tasks and are reduced
    to copy counts before they meet a row; a row drawn very often is split over
    tasks. Only classes that are drawn from are ranked, and only by their keys.
    """
    lab = F.col(f"`{label}`")
    sizes = hold(class_table(df, label)) if sizes is None else sizes
    per_split = F.col("size") * COPIES_PER_TASK_ROW
    plan = table_of(df, label, draws, "n").where("n > 0").join(sizes.where("size > 0"), "label")
    plan = hold(plan.withColumn("splits", F.ceil(F.col("n") / per_split).cast("long")))
    told = plan.agg(F.max("size").alias("size"), F.max("splits").alias("splits")).first()
    if told["size"] is None:
        return df.limit(0)
    wanted = _labels(df, label, plan)
    items = wanted.select(lab.alias("label"), seeded_code(seed, key).alias("code"), F.col(f"`{key}`").alias("key"))
    ranked = positions(items, told["size"], leaf_rows).select("label", "pos", F.col("key").alias(key))

    per_row = F.lit(DRAWS_PER_ROW).cast("long")
    rows = plan.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {DRAWS_PER_ROW}L)")).alias("row")).repartition("label", "row")
    last = F.least(F.col("n"), (F.col("row") + 1) * per_row) - 1
    drawn = rows.select("label", "size", "splits", F.explode(F.sequence(F.col("row") * per_row, last)).alias("d"))
    drawn = drawn.select(
        "label",
        draw_number(seeded_code(seed, "label", "d"), F.col("size")).alias("pos"),
        (F.col("d") % F.col("splits")).alias("part"),
    )
    copies = drawn.groupBy("label", "pos", "part").agg(F.count(F.lit(1)).alias("copies"))
    chosen = copies.join(ranked, ["label", "pos"]).select(key, "copies", "part")
    rows = wanted.join(chosen, key)
    if told["splits"] > 1:
        rows = rows.repartition(F.col(f"`{key}`"), F.col("part"))
    repeated = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*df.columns)


def _is_base(df: DataFrame, label: str, base: object) -> Column:
    return F.col("label") == F.lit(base).cast(df.schema[label].dataType)


def _shares(df: DataFrame, label: str, sizes: DataFrame, base: object, others: int | None) -> DataFrame:
    """(label, n): draws that each other class lacks for an equal share of the base class."""
    told = sizes.agg(F.max(F.when(_is_base(df, label, base), F.col("size"))).alias("n"), F.count(F.when(~_is_base(df, label, base), 1)).alias("others")).first()
    share = (told["n"] or 0) / max(1, told["others"] if others is None else others)
    lacking = F.greatest(F.lit(0), F.floor(F.lit(float(share)) - F.col("size")))
    return sizes.where(~_is_base(df, label, base)).select("label", lacking.cast("long").alias("n"))


def top_up(df: DataFrame, key: str, label: str, seed: int, base: object = 0, sizes: DataFrame | None = None, others: int | None = None, **how) -> DataFrame:
    """Bring every other class up to an equal share of the base class.

    Originals stay; a class already above its share is left alone. ``others`` is the number of
    classes that share; by default those that are there.
    """
    sizes = hold(class_table(df, label)) if sizes is None else sizes
    return df.unionByName(extra_draws(df, key, label, _shares(df, label, sizes, base, others), seed, sizes, **how))


def under_then_top_up(df: DataFrame, key: str, label: str, n: int, seed: int, base: object = 0, others: int | None = None, **how) -> DataFrame:
    """Cut the base class to ``n`` rows, then top the others up to its share."""
    sizes = hold(class_table(df, label))
    kept = keep_exactly(df, key, label, {base: n}, seed, sizes, **how)
    left = sizes.withColumn("size", F.when(_is_base(df, label, base), F.least(F.col("size"), F.lit(n))).otherwise(F.col("size")))
    return kept.unionByName(extra_draws(df, key, label, _shares(df, label, left, base, others), seed, sizes, **how))


def balanced_bag(df: DataFrame, key: str, label: str, n_base: int, n_other: int, seed: int, base: object = 0, **how) -> DataFrame:
    """``n_base`` rows of the base class and ``n_other`` draws of each other class."""
    sizes = hold(class_table(df, label))
    kept = keep_exactly(df.filter(F.col(f"`{label}`") == base), key, label, {base: n_base}, seed, sizes, **how)
    draws = sizes.where(~_is_base(df, label, base)).select("label", F.lit(n_other).cast("long").alias("n"))
    return kept.unionByName(extra_draws(df, key, label, draws, seed, sizes, **how))


def over_sample(df: DataFrame, key: str, label: str, seed: int, sizes: DataFrame | None = None, **how) -> DataFrame:
    """Draw every class up to the size of the largest; originals stay.

    ``sizes`` are the classes' sizes, where they are known.
    """
    sizes = hold(class_table(df, label)) if sizes is None else sizes
    most = sizes.agg(F.max("size")).first()[0] or 0
    return df.unionByName(extra_draws(df, key, label, sizes.select("label", (F.lit(most) - F.col("size")).alias("n")), seed, sizes, **how))


def under_then_over(df: DataFrame, key: str, label: str, shrink: Plan, seed: int, **how) -> DataFrame:
    """Cut the named classes to fixed sizes, then over-sample."""
    sizes = hold(class_table(df, label))
    kept = keep_exactly(df, key, label, shrink, seed, sizes, **how)
    cut = table_of(df, label, shrink, "n")
    left = hold(sizes.join(cut, "label", "left").select("label", F.least("size", F.coalesce("n", "size")).alias("size")))
    return over_sample(kept, key, label, seed, left, **how)


def stratified_fraction(df: DataFrame, key: str, label: str, parts: int, seed: int, **how) -> DataFrame:
    """One of ``parts`` equal parts of each class, rounded up."""
    sizes = hold(class_table(df, label))
    wanted = sizes.select("label", F.expr(f"(size + {parts - 1}) div {parts}").alias("n"))
    return keep_exactly(df, key, label, wanted, seed, sizes, **how)


def class_weight_table(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): balanced weight per class, rows / (classes * rows of the class)."""
    sizes = hold(class_table(df, label))
    told = sizes.agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    return sizes.select("label", (F.lit(float(told["rows"] or 0)) / (F.lit(told["classes"]) * F.col("size"))).alias("weight"))


def class_weights(df: DataFrame, label: str) -> dict[object, float]:
    """The same as a dictionary, for few classes."""
    return {r["label"]: r["weight"] for r in class_weight_table(df, label).collect()}


def with_class_weight(df: DataFrame, label: str, weights: Mapping[object, float] | DataFrame, name: str = "weight", row_key: str | None = None) -> DataFrame:
    """The weight of each row's class; rows of other classes, or without one, get NULL."""
    table = table_of(df, label, weights, "weight", "double").select(F.col("label").alias(label), F.col("weight").alias(name))
    return enrich(df, table, label, row_key=row_key)
