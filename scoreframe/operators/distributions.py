"""Distributions compared by group.

Groups may hold any share of the rows: rows are first counted by (group, value), and
the values are cut into ranges, so that no window holds more than a range of a group.
What lies before a range comes from the few totals of the ranges.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions.numbers import rounded

#: Ranges that values are cut into, at least; more where the session has more shuffle partitions.
LEAST_RANGES = 16
#: Points of the tail profile, and the one that its tail mean is taken at.
SHARES, TAIL = {"p01": 0.01, "p05": 0.05, "p95": 0.95, "p99": 0.99}, "p05"


def in_ranges(rows: DataFrame, of: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``__range``, the number of the range that ``value`` is in; ``of`` has the values that the ranges share evenly.

    Split points are approximate shares of all rows, so a range holds about as many
    as any other, or the rows of one value. NaN comes last, as in Spark's order.
    """
    n = max(LEAST_RANGES, int(of.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = of.agg(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    splits = [-math.inf, *sorted({x for x in found if math.isfinite(x)}), math.inf]
    number = Bucketizer(splits=splits if len(splits) > 2 else [-math.inf, 0.0, math.inf], inputCol=value, outputCol="__at", handleInvalid="keep")
    return number.transform(rows).withColumn("__range", F.col("__at").cast("int")).drop("__at")


def group_superiority(rows: DataFrame, pairs: DataFrame, group: str, value: str, a: str = "a", b: str = "b") -> DataFrame:
    """For each pair of groups, the chance that a value of the one is above a value of the other, ties counting half.

    Works on the counts of (group, value): each value of a is placed among the
    running counts of b, by a window over both groups' values of a pair and range.
    Pairs with a group that has no value are left out.
    """
    good = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    counts = in_ranges(good.groupBy(F.col(group).alias("__g"), F.col(value).alias("__v")).agg(F.count(F.lit(1)).cast("double").alias("n")), good.select(F.col(value).alias("__v")), "__v")
    left = pairs.join(counts, F.col(a) == F.col("__g")).select(a, b, "__range", "__v", F.col("n").alias("n_a"), F.lit(0.0).alias("n_b"))
    right = pairs.join(counts, F.col(b) == F.col("__g")).select(a, b, "__range", "__v", F.lit(0.0).alias("n_a"), F.col("n").alias("n_b"))
    both = left.union(right).groupBy(a, b, "__range", "__v").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    upto = F.sum("n_b").over(Window.partitionBy(a, b, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    wins = both.withColumn("twice", F.col("n_a") * (2 * upto - F.col("n_b")))
    ranges = wins.groupBy(a, b, "__range").agg(*(F.sum(c).alias(c) for c in ("twice", "n_a", "n_b")))
    before = F.coalesce(F.sum("n_b").over(Window.partitionBy(a, b).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = ranges.withColumn("twice", F.col("twice") + 2 * before * F.col("n_a")).groupBy(a, b).agg(*(F.sum(c).alias(c) for c in ("twice", "n_a", "n_b")))
    return whole.where("n_a > 0 AND n_b > 0").select(a, b, rounded(F.col("twice") / (2.0 * F.col("n_a") * F.col("n_b")), 6).alias("p_superior"))


def tail_profile(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, standard deviation, excess kurtosis, exact 1, 5, 95 and 99 % points, and the mean at or below the 5 % point.

    Null and NaN values and rows without a group don't count; infinite values do.
    A group with an infinite value has what doubles give: an infinite mean (none,
    NaN, if both signs occur) and no deviation or kurtosis (null); its points and
    its tail mean are those of the order. The deviation of a single row and the
    kurtosis of equal values are null. Sums are taken of distances from a value of
    the group, in units of the group's largest distance, so 1e300 and 1e-300 keep their digits.
    """
    good = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(group).alias("__g"), F.col(value).cast("double").alias("__v"))
    counts = in_ranges(good.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__n")), good, "__v")

    # A value near the middle of the finite ones, and the largest distance from it: what follows has no sum beyond the number of rows.
    finite = F.when(F.abs("__v") < float("inf"), F.col("__v"))
    frame = counts.groupBy(F.col("__g").alias("__k")).agg(F.min(finite).alias("__least"), F.max(finite).alias("__most"))
    low, high = F.coalesce("__least", F.lit(0.0)), F.coalesce("__most", F.lit(0.0))
    frame = frame.select("__k", (low / 2 + high / 2).alias("__c"), F.when(high > low, high / 2 - low / 2).otherwise(1.0).alias("__u"))
    counts = counts.join(frame, F.col("__g") == F.col("__k")).withColumn("__x", (F.col("__v") - F.col("__c")) / F.col("__u")).drop("__k")

    # The group's mean comes from its ranges' sums; powers are then taken of distances from it, so no digits are lost.
    weighed = F.col("__n") * F.col("__x")
    ranges = counts.groupBy(F.col("__g").alias("__h"), F.col("__range").alias("__r")).agg(F.sum("__n").alias("__rn"), F.sum(weighed).alias("__rs"))
    order = Window.partitionBy("__h").orderBy("__r")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("__h")
    totals = ranges.select(
        "__h", "__r", F.coalesce(F.sum("__rn").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__rs").over(before), F.lit(0.0)).alias("__s0"),
        F.sum("__rn").over(whole).alias("n"), (F.sum("__rs").over(whole) / F.sum("__rn").over(whole)).alias("m"))

    within = Window.partitionBy("__g", "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.join(totals, (F.col("__g") == F.col("__h")) & (F.col("__range") == F.col("__r")))
    running = running.withColumns({"__upto": F.col("__n0") + F.sum("__n").over(within), "__sum": F.col("__s0") + F.sum(weighed).over(within), "d": F.col("__x") - F.col("m")})
    upto, held = F.col("__upto"), F.col("__n")

    def place(share: float) -> Column:
        return (F.col("n") - 1) * F.lit(share)

    def at(place: Column, what: Column) -> Column:
        """``what`` of the row that holds a place, counted from 0."""
        return F.max(F.when((upto - held <= place) & (place < upto), what))

    ends = [at(end(place(share)), F.col("__v")).alias(f"{name}_{end.__name__}") for name, share in SHARES.items() for end in (F.floor, F.ceil)]
    tail = at(F.floor(place(SHARES[TAIL])), F.struct(F.col("__sum").alias("s"), upto.alias("n"))).alias("tail")
    sums = running.groupBy("__g").agg(
        *(F.first(c).alias(c) for c in ("n", "m", "__c", "__u")), F.sum(held * F.pow("d", F.lit(2))).alias("d2"), F.sum(held * F.pow("d", F.lit(4))).alias("d4"), tail, *ends)

    def point(name: str) -> Column:
        low, high, part = F.col(f"{name}_floor"), F.col(f"{name}_ceil"), place(SHARES[name]) - F.floor(place(SHARES[name]))
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    n, known = F.col("n"), F.abs("m") < float("inf")
    whole_again = lambda x: F.col("__c") + F.col("__u") * x
    return sums.select(
        F.col("__g").alias(group), "n", rounded(whole_again(F.col("m")), 4).alias("mean"), rounded(F.when(known, F.col("__u") * F.sqrt(F.try_divide("d2", n - 1))), 4).alias("stddev"),
        rounded(F.when(known, F.try_divide(n * F.col("d4"), F.col("d2") * F.col("d2")) - 3), 4).alias("excess_kurtosis"),
        *(rounded(point(name), 4).alias(name) for name in SHARES), rounded(whole_again(F.col("tail.s") / F.col("tail.n")), 4).alias("tail_mean"))
