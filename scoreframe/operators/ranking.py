"""Ranks, best rows, first rows and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that pairs are compared by.
COMPARED = ["profit", "probability", "style"]


def ranked(rows: DataFrame, key: str, group: str, by: str = "profit") -> DataFrame:
    """``rows`` with rank within ``group``, from the largest ``by`` on, ties to the smaller key.

    Ranges of the order are ranked apart, so a group of any size is spread over the
    tasks. The last rows of a group's ranges meet, a row a range, and tell how many
    rows come before each range.
    """
    order = [F.col(by).desc(), F.col(key)]
    ranges = rows.repartitionByRange(F.col(group), *order).withColumn("__range", F.spark_partition_id())
    within, whole = Window.partitionBy(group, "__range").orderBy(*order), Window.partitionBy(group, "__range")
    placed = ranges.withColumns({"__at": F.row_number().over(within), "__last": F.lead(F.lit(True)).over(within).isNull()})
    lasts = Window.partitionBy(group, "__last", F.when(F.col("__last"), -1).otherwise(F.col("__range"))).orderBy("__range", "__at").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.withColumn("__before", F.when(F.col("__last"), F.coalesce(F.sum("__at").over(lasts), F.lit(0))))
    return before.withColumn("rank", (F.max("__before").over(whole) + F.col("__at")).cast("int")).select(*rows.columns, "rank")


def top(rows: DataFrame, key: str, by: str = "profit", group: str | None = None, n: int = 1) -> DataFrame:
    """The first ``n`` rows by rank, of each group if given; each task keeps its own first ``n`` before the groups meet."""
    if group:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(by).desc(), key))).where(F.col("rank") <= n)
    return rows.orderBy(F.col(by).desc(), key).limit(n)


def message(profit: Column) -> Column:
    """What is said of the best row."""
    return F.when(profit.isNull(), "no_candidate").when(profit <= 0, "no_profitable_candidate").otherwise("recommended")


def first_n(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.orderBy(key).limit(n)


def placed(rows: DataFrame, key: str, group: str, by: str = "profit") -> DataFrame:
    """``rows`` with rank within ``group`` and place among all, in the order of place: the form in which ranks are stored and read for any top-k."""
    grouped = ranked(rows, key, group, by).withColumn("__everyone", F.lit(0))
    order = [c for c in grouped.columns if c not in ("rank", "__everyone")]
    return ranked(grouped.withColumnRenamed("rank", "__rank"), key, "__everyone", by).select(*order, F.col("__rank").alias("rank"), F.col("rank").alias("place"))


def neighbours(placed_rows: DataFrame, key: str, columns: list[str], n: int | None = None) -> DataFrame:
    """Pairs (a, b) of :func:`placed` rows that stand one behind the other, among the first ``n`` if given, with both sides' ``columns``."""
    first = placed_rows if n is None else placed_rows.where(F.col("place") <= n)
    a = first.select(F.col(key).alias("a"), F.col("place").alias("__at"), *(F.col(c).alias(f"{c}_a") for c in columns))
    b = first.select(F.col(key).alias("b"), (F.col("place") - 1).alias("__before"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return a.join(b, F.col("__at") == F.col("__before")).drop("__at", "__before")


def compared(pairs: DataFrame, rows: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """For each of the ``pairs``: who has more profit, who has more probability (ties: the second), and both styles."""
    sides = [rows.select(F.col(key).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in COMPARED)) for s in (a, b)]
    return judged(pairs.join(sides[0], a).join(sides[1], b), a, b)


def judged(joined: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """What :func:`compared` says of pairs that have both sides' columns."""
    return joined.select(
        a, b, F.when(F.col(f"profit_{a}") > F.col(f"profit_{b}"), F.col(a)).otherwise(F.col(b)).alias("more_profit"),
        F.when(F.col(f"probability_{a}") > F.col(f"probability_{b}"), F.col(a)).otherwise(F.col(b)).alias("more_probable"), f"style_{a}", f"style_{b}")


def neighbour_pairs(rows: DataFrame, key: str, by: str = "profit", n: int | None = None) -> DataFrame:
    """Pairs (a, b) of neighbours in rank among all rows, or the best ``n``.

    Ranges of the order are worked apart: a row's neighbour is the next one of its
    range. The first and last rows of all ranges form a group of their own, in which
    a last row is followed by the first one of the next range.
    """
    rows = rows.select(F.col(key).alias("a"), F.col(by).alias("__by"))
    order = [F.col("__by").desc(), F.col("a")]
    if n is not None:
        return rows.orderBy(*order).limit(n).select("a", F.lead("a").over(Window.orderBy(*order)).alias("b")).where("b IS NOT NULL")
    ranges = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    within = Window.partitionBy("__range").orderBy(*order)
    placed = ranges.withColumns({"b": F.lead("a").over(within), "__first": F.row_number().over(within) == 1})
    edges = Window.partitionBy(F.when(F.col("b").isNull() | F.col("__first"), -1).otherwise(F.col("__range"))).orderBy(*order)
    return placed.withColumn("__next", F.lead("a").over(edges)).select("a", F.coalesce("b", "__next").alias("b")).where("b IS NOT NULL")
