"""Named predicates, filters made of them, and text requests answered by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The five predicates as SQL, in registry order.
STRATEGIES = {
    "rentable": "profit > 0",
    "offensif": "shots >= 5",
    "efficace": "efficiency = 'clinical_finisher'",
    "low_risk": "probability > 0.6D",
    "polyvalent": "style = 'balanced_player'",
}
#: Reason codes of the strategies that have one, and of a fallback.
REASONS = {"rentable": "positive_expected_profit", "offensif": "offensive_volume", "efficace": "clinical_finishing", "low_risk": "high_probability"}
FALLBACK_REASON = "no_exact_match"


def predicate(name: str) -> Column:
    return F.coalesce(F.expr(STRATEGIES[name]), F.lit(False))


def flagged(rows: DataFrame) -> DataFrame:
    """A boolean column for each strategy."""
    return rows.withColumns({f"is_{n}": predicate(n) for n in STRATEGIES})


def filtered(rows: DataFrame, chosen: list[str]) -> DataFrame:
    """Rows that all chosen strategies accept; none chosen: all rows."""
    return rows.where(reduce(lambda a, b: a & b, (predicate(n) for n in chosen), F.lit(True)))


def with_fallback(rows: DataFrame, chosen: list[str]) -> DataFrame:
    """Rows that pass, fallback false; if none passes, all rows with fallback true."""
    passes = reduce(lambda a, b: a & b, (predicate(n) for n in chosen), F.lit(True))
    marked = rows.withColumn("__passes", passes)
    found = marked.agg(F.coalesce(F.bool_or("__passes"), F.lit(False)).alias("__any"))
    return marked.join(F.broadcast(found), F.lit(True)).where("__passes OR NOT __any").withColumn("fallback", ~F.col("__any")).drop("__passes", "__any")


def relaxed(rows: DataFrame, chosen: list[str], dropped: str = "rentable") -> DataFrame:
    """The strictest level with rows: 0 all chosen, 1 without ``dropped``, 2 none; with that level."""
    strict, loose = (reduce(lambda a, b: a & b, (predicate(n) for n in names), F.lit(True)) for names in (chosen, [n for n in chosen if n != dropped]))
    marked = rows.withColumn("__level", F.when(strict, 0).when(loose, 1).otherwise(2))
    least = marked.agg(F.min("__level").alias("level"))
    return marked.join(F.broadcast(least), F.col("__level") <= F.col("level")).drop("__level")


def detected(requests: DataFrame, words: dict[str, str], text: str = "text") -> DataFrame:
    """``requests`` with strategies: those whose word the lower-cased text contains, in registry order."""
    found = F.array(*(F.when(F.contains(F.lower(F.col(text)), F.lit(words[n])), n) for n in STRATEGIES))
    return requests.withColumn("strategies", F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<string>")))


def reason_codes(strategies: Column) -> Column:
    """The codes of the chosen strategies, in registry order; none: the fallback code."""
    codes = F.filter(F.array(*(F.when(F.array_contains(strategies, n), r) for n, r in REASONS.items())), lambda x: x.isNotNull())
    return F.when(F.size(codes) == 0, F.array(F.lit(FALLBACK_REASON))).otherwise(codes)


def _mask(strategies: Column) -> Column:
    return sum((F.when(F.array_contains(strategies, n), 1 << i).otherwise(0) for i, n in enumerate(STRATEGIES)), F.lit(0))


def lattice(rows: DataFrame, key: str, by: str = "profit", keep: tuple[str, ...] = ()) -> DataFrame:
    """For each set of strategies that some row passes: set (a bit a strategy), n (rows that pass all of it), best (key, ``by`` and ``keep`` of the best).

    Rows are aggregated by the strategies that they pass, 32 sets at most; each of
    these counts for all its subsets. No row is repeated.
    """
    passed = sum((F.when(predicate(n), 1 << i).otherwise(0) for i, n in enumerate(STRATEGIES)), F.lit(0))
    order = F.struct(F.col(by).isNull().alias("none"), (-F.col(by)).alias("less"), F.col(key).alias("key"), F.struct(key, by, *keep).alias("row"))
    own = rows.groupBy(passed.alias("__own")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("best"))
    every = F.sequence(F.lit(0), F.lit((1 << len(STRATEGIES)) - 1))
    below = own.withColumn("set", F.explode(F.filter(every, lambda s: F.col("__own").bitwiseAND(s) == s)))
    return below.groupBy("set").agg(F.sum("n").alias("n"), F.min("best").alias("best")).select("set", "n", F.col("best.row").alias("best"))


def recommended(requests: DataFrame, rows: DataFrame, key: str, by: str = "profit", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each request (with strategies) and the best row that its strategies accept, or the best of all with fallback true; ``keep`` are more columns of that row.

    Ties in ``by`` go to the smaller key, rows without ``by`` come last. Without any row all is null and fallback true.
    """
    sets = lattice(rows, key, by, keep)
    everything = sets.where("set = 0").select(F.col("best").alias("any_best"))
    wanted = requests.withColumn("__wanted", _mask(F.col("strategies")))
    joined = wanted.join(F.broadcast(sets.select(F.col("set").alias("__set"), "best")), F.col("__wanted") == F.col("__set"), "left").join(F.broadcast(everything), F.lit(True), "left")
    pick = F.coalesce("best", "any_best")
    return joined.select(*requests.columns, *(pick[c].alias(c) for c in (key, by)), F.col("best").isNull().alias("fallback"), *(pick[c].alias(c) for c in keep))


def relaxed_requests(requests: DataFrame, rows: DataFrame, key: str, by: str = "profit", dropped: tuple[str, ...] = ("rentable",)) -> DataFrame:
    """Each request (with strategies) at its own lowest level that has rows: level, strategies_left, n (rows) and the best one's key and ``by``.

    Level 0 asks for all chosen strategies, each further level gives up one more of
    ``dropped``, and the last asks for none. Levels are found once for each set of
    strategies, 32 at most, and requests meet their set's by a broadcast of these;
    without any row all five are null.
    """
    sets = lattice(rows, key, by)
    bits = {n: 1 << i for i, n in enumerate(STRATEGIES)}
    given_up = [sum(bits[n] for n in dropped[:k]) for k in range(len(dropped) + 1)]
    every = requests.sparkSession.range(1 << len(STRATEGIES)).select(F.col("id").cast("int").alias("__wanted"))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.col("__wanted").bitwiseAND(~gone & 31).alias("set")) for k, gone in enumerate(given_up)), F.struct(F.lit(len(given_up)).alias("level"), F.lit(0).alias("set")))
    tried = every.select("__wanted", F.explode(levels).alias("l")).join(sets, F.col("l.set") == F.col("set"))
    lowest = tried.groupBy("__wanted").agg(F.min_by(F.struct("l.level", "set", "n", "best"), "l.level").alias("found"))
    left = F.filter(F.array(*(F.when(F.col("found.set").bitwiseAND(b) == b, n) for n, b in bits.items())), lambda x: x.isNotNull())
    asked = requests.withColumn("__asked", _mask(F.col("strategies"))).join(F.broadcast(lowest), F.col("__asked") == F.col("__wanted"), "left")
    return asked.select(*requests.columns, "found.level", F.when(F.col("found").isNotNull(), left).alias("strategies_left"), "found.n", *(F.col(f"found.best.{c}").alias(c) for c in (key, by)))


def response(rows: DataFrame, key: str, by: str = "profit") -> DataFrame:
    """``rows`` of :func:`recommended` with the response text."""
    criteria = F.when(F.size("strategies") == 0, "none").otherwise(F.concat_ws(", ", "strategies"))
    note = F.when(F.col("fallback"), F.lit("note: no row meets all criteria"))
    said = F.concat_ws("\n", F.concat(F.lit("recommended: "), F.col(key).cast("string")), F.concat(F.lit("criteria: "), criteria), F.concat(F.lit("reasons: "), F.concat_ws(", ", reason_codes(F.col("strategies")))), note)
    return rows.withColumn("response", said)
