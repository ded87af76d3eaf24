"""Posterior of a rate from additive sums: LogNormal prior, Poisson likelihood, quadrature in Catalyst.

With S the sum of exposure and G of outcomes, the log posterior of t = log(rate) is
G t - S exp(t) - (t - log m)^2 / (2 s^2) up to a constant. It is log-concave, so
everything outside ``SDS`` standard deviations around the mode is next to nothing,
and Gauss-Legendre points in that range integrate it, whatever the sums: one rule
for all keys, from none to 1e10 outcomes. All places are offsets d = t - mode, which
keeps the digits of large sums.

Points are exploded rows and an aggregate on the same key, so there is one shuffle
and no UDF. What needs the distribution function (quantiles, intervals, the chance
that one rate is above another) reads it from one short array a key: the chances
below the edges of ``CELLS`` cells, and inside a cell a local integral.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.numbers import rounded

#: The prior's standard deviation, and those of the posterior that are looked at on each side of the mode.
SIGMA, SDS = 0.5, 8.0
#: Gauss-Legendre points on each side of the threshold, and in a cell.
SIDE_POINTS, CELL_POINTS = 26, 6
#: Cells of the distribution function, each of one standard deviation.
CELLS = 16
#: Newton steps for the mode, and for the ends of intervals; each doubles the right digits.
NEWTON, END_STEPS = 8, 6
#: Shares that the interval leaves out below and above; its inside is also the highest-density interval's share.
LOW, HIGH = 0.03, 0.97


def gauss(points: int) -> list[tuple[float, float]]:
    """Places and weights of Gauss-Legendre quadrature on (0, 1)."""
    x, w = np.polynomial.legendre.leggauss(points)
    return [((1 + a) / 2, b / 2) for a, b in zip(x.tolist(), w.tolist(), strict=True)]


def _modes(rows: DataFrame, exposure: str, outcome: str) -> DataFrame:
    """``rows`` that the model allows, with S, G, and mode and sd of the log rate."""
    tight = 1 / SIGMA**2
    s, g = F.col(exposure).cast("double"), F.col(outcome).cast("double")
    finite = (s < float("inf")) & (g < float("inf"))
    allowed = rows.where((s >= 0) & (g >= 0) & finite & ~((s == 0) & (g > 0))).withColumns({"__s": s, "__g": g})
    s, g = F.col("__s"), F.col("__g")
    # The mode solves S exp(t) + t / s^2 = G. Newton falls to it from any bound above it.
    far = F.greatest(F.log(s / F.greatest(g, F.lit(1.0))), F.lit(1 / tight))
    above = F.when(s == 0, 0.0).when(g > s, F.least(g / tight, F.log(g / s))).otherwise(F.least(F.lit(0.0), F.log((g + tight * far) / s)))
    out = allowed.withColumn("__m", above)
    for _ in range(NEWTON):
        pull = s * F.exp("__m")
        out = out.withColumn("__m", F.col("__m") - (pull + tight * F.col("__m") - g) / (pull + tight))
    return out.withColumn("__sd", 1 / F.sqrt(s * F.exp("__m") + tight))


def _density(d: Column, side: str = "") -> Column:
    """The posterior's density at ``d`` over that at the mode."""
    s, g, m = (F.col(f"__{c}{side}") for c in "sgm")
    return F.exp(g * d - s * F.exp(m) * F.expm1(d) - (d + 2 * m) * d / (2 * SIGMA**2))


def _slope(d: Column) -> Column:
    """The slope of the log density at ``d``."""
    s, g, m = (F.col(f"__{c}") for c in "sgm")
    return g - s * F.exp(m) * F.exp(d) - (d + m) / SIGMA**2


def rated(rows: DataFrame, key: str, exposure: str = "xg_total", outcome: str = "goals_total", digits: int = 4) -> DataFrame:
    """``rows`` with mean_rate, probability (rate above 1), sd_rate, edge_mass and sd_steps.

    As :func:`rate_posterior`, but all columns stay: they pass through the aggregate, so nothing is joined back.
    """
    kept = [F.col(c) for c in rows.columns]
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in gauss(SIDE_POINTS)))
    reach = SDS * F.col("__sd")
    # Rate 1 lies at d = -mode; where that is out of reach, one side is empty.
    modes = _modes(rows, exposure, outcome).withColumn("__cut", F.least(F.greatest(-F.col("__m"), -reach), reach))
    sides = modes.withColumn("__p", F.explode(points))
    x, w, cut = F.col("__p.x"), F.col("__p.w"), F.col("__cut")
    below, above = -reach + (cut + reach) * x, cut + (reach - cut) * x
    sides = sides.select("*", below.alias("__below"), above.alias("__above"))
    sides = sides.withColumns({"__down": w * (cut + reach) * _density(F.col("__below")), "__up": w * (reach - cut) * _density(F.col("__above"))})
    down, up, e_down, e_up = F.col("__down"), F.col("__up"), F.expm1("__below"), F.expm1("__above")
    # Rates over the mode's, less one: their moments keep the digits that a narrow posterior needs.
    sums = sides.groupBy(*kept, "__s", "__g", "__m", "__sd", "__cut").agg(
        F.sum(down + up).alias("__w"), F.sum("__up").alias("__over"), F.sum(down * e_down + up * e_up).alias("__w1"), F.sum(down * e_down * e_down + up * e_up * e_up).alias("__w2"))
    mode, first = F.exp("__m"), F.col("__w1") / F.col("__w")
    gap = max(b - a for (a, _), (b, _) in zip(gauss(SIDE_POINTS), gauss(SIDE_POINTS)[1:], strict=False))
    return sums.select(
        *kept, rounded(mode * (1 + first), digits).alias("mean_rate"), rounded(F.col("__over") / F.col("__w"), digits).alias("probability"),
        rounded(mode * F.sqrt(F.greatest(F.col("__w2") / F.col("__w") - first * first, F.lit(0.0))), digits).alias("sd_rate"),
        rounded((_density(reach) + _density(-reach)) * F.col("__sd") / F.col("__w"), 9).alias("edge_mass"),
        rounded(F.col("__sd") / (gap * F.greatest(reach - cut, reach + cut)), 2).alias("sd_steps"))


def rate_posterior(rows: DataFrame, key: str, exposure: str = "xg_total", outcome: str = "goals_total", digits: int = 4) -> DataFrame:
    """key, mean_rate, probability (rate above 1), sd_rate, edge_mass and sd_steps, rounded to ``digits``.

    ``rows`` has one row a key. No exposure and no outcome gives the prior. A key
    with outcomes on no exposure, or with a missing, negative or infinite sum, is
    left out (see :func:`quality`). edge_mass estimates what lies out of reach;
    sd_steps is the posterior's standard deviation in widest gaps between points: never below 1.
    """
    of = rows.select(F.col(key), F.col(exposure).alias("__exposure"), F.col(outcome).alias("__outcome"))
    return rated(of, key, "__exposure", "__outcome", digits).drop("__exposure", "__outcome")


def distribution(rows: DataFrame, key: str, exposure: str = "xg_total", outcome: str = "goals_total") -> DataFrame:
    """key, S, G, mode, sd and ``__upto``: the weight below each of the edges of the cells, an array a key."""
    of = rows.select(F.col(key), F.col(exposure).alias("__exposure"), F.col(outcome).alias("__outcome"))
    modes = _modes(of, "__exposure", "__outcome").drop("__exposure", "__outcome")
    cells = modes.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    weight = _integral((F.col("__i") - SDS) * F.col("__sd"), F.col("__sd"))
    held = cells.groupBy(key, "__s", "__g", "__m", "__sd").agg(F.sort_array(F.collect_list(F.struct(F.col("__i").alias("i"), weight.alias("w")))).alias("__cells"))
    upto = F.aggregate("__cells", F.array(F.lit(0.0)), lambda done, c: F.concat(done, F.array(F.element_at(done, -1) + c["w"])))
    return held.select(key, "__s", "__g", "__m", "__sd", upto.alias("__upto"))


def _integral(start: Column, length: Column, side: str = "") -> Column:
    """The weight between ``start`` and ``start + length``, up to one standard deviation apart."""
    return length * sum((w * _density(start + x * length, side) for x, w in gauss(CELL_POINTS)), F.lit(0.0))


def _below(d: Column, side: str = "") -> Column:
    """The weight below ``d``, from the edge of its cell on."""
    sd, upto = F.col(f"__sd{side}"), F.col(f"__upto{side}")
    cell = F.least(F.greatest(F.floor(d / sd + SDS), F.lit(0)), F.lit(CELLS - 1)).cast("int")
    edge = (cell - SDS) * sd
    inside = F.least(F.greatest(d - edge, F.lit(0.0)), sd)
    return F.get(upto, cell) + _integral(edge, inside, side)


def _with_quantile(of: DataFrame, share: float, name: str) -> DataFrame:
    """``of`` with the offset below which ``share`` of the weight lies: Newton's steps inside the cell that holds it."""
    total, sd = F.element_at("__upto", -1), F.col("__sd")
    want = share * total
    cell = F.least(F.size(F.filter("__upto", lambda w: w <= want)) - 1, F.lit(CELLS - 1))
    out = of.withColumns({"__cell": cell, "__want": want})
    edge, start, end = (F.col("__cell") - SDS) * sd, F.get("__upto", F.col("__cell")), F.get("__upto", F.col("__cell") + 1)
    out = out.withColumn(name, edge + sd * (F.col("__want") - start) / (end - start))
    for _ in range(END_STEPS):
        missing = F.col("__want") - start - _integral(edge, F.col(name) - edge)
        out = out.withColumn(name, F.least(F.greatest(F.col(name) + missing / _density(F.col(name)), edge), edge + sd))
    return out.drop("__cell", "__want")


def _with_densest(of: DataFrame, share: float, a: str, b: str, low: str, high: str) -> DataFrame:
    """``of`` with the ends a and b of the shortest interval that holds ``share``: equal densities, found by Newton's steps from low and high."""
    total, reach = F.element_at("__upto", -1), SDS * F.col("__sd")
    out = of.withColumns({a: F.col(low), b: F.col(high)})
    for _ in range(END_STEPS):
        x, y = F.col(a), F.col(b)
        out = out.withColumns({
            "__fa": _density(x), "__fb": _density(y), "__la": _slope(x), "__lb": _slope(y), "__more": share * total - _below(y) + _below(x),
        })
        # fb db - fa da = more, lb db - la da = log(fa / fb)
        even = F.log(F.col("__fa") / F.col("__fb"))
        by = F.col("__fa") * F.col("__lb") - F.col("__fb") * F.col("__la")
        da = (F.col("__fb") * even - F.col("__more") * F.col("__lb")) / by
        db = (F.col("__fa") * even - F.col("__more") * F.col("__la")) / by
        out = out.withColumns({a: F.least(F.greatest(x + da, -reach), F.lit(0.0)), b: F.greatest(F.least(y + db, reach), F.lit(0.0))})
    return out.drop("__fa", "__fb", "__la", "__lb", "__more")


def posterior_summary(rows: DataFrame, key: str, exposure: str = "xg_total", outcome: str = "goals_total", low: float = LOW, high: float = HIGH) -> DataFrame:
    """key, mean_rate, sd_rate, the equal-tailed interval (low, high), and the shortest interval of log rates that holds as much (densest_low, densest_high).

    ``rows`` and left-out keys are those of :func:`rate_posterior`; ends are right to four digits at all sizes.
    """
    moments = rate_posterior(rows, key, exposure, outcome).select(F.col(key).alias("__key"), "mean_rate", "sd_rate")
    ends = _with_quantile(_with_quantile(distribution(rows, key, exposure, outcome), low, "__low"), high, "__high")
    ends = _with_densest(ends, high - low, "__from", "__to", "__low", "__high")
    at = {n: rounded(F.exp(F.col("__m") + F.col(c)), 4).alias(n) for n, c in (("low", "__low"), ("high", "__high"), ("densest_low", "__from"), ("densest_high", "__to"))}
    return moments.join(ends.select(F.col(key), *at.values()), F.col("__key").eqNullSafe(F.col(key))).select(key, "mean_rate", "sd_rate", *at)


def quality(rows: DataFrame, key: str, exposure: str = "xg_total", outcome: str = "goals_total") -> DataFrame:
    """Keys that have no posterior, and why."""
    s, g = F.col(exposure).cast("double"), F.col(outcome).cast("double")
    infinite = ~((s < float("inf")) & (g < float("inf")))
    why = F.when(s.isNull() | g.isNull(), "missing_sum").when((s < 0) | (g < 0), "negative_sum").when(infinite, "infinite_sum").when((s == 0) & (g > 0), "outcome_without_exposure")
    return rows.select(key, why.alias("reason")).where("reason IS NOT NULL")


def expected_profit(mean_rate: Column, exposure: Column, costs: Column, factor: float = 10.0) -> Column:
    return rounded(mean_rate * exposure * factor - costs)


def decision(profit: Column) -> Column:
    return F.when(profit > 0, "recruit").otherwise("do_not_recruit")


def superiority(pairs: DataFrame, rows: DataFrame, key: str, a: str = "a", b: str = "b", exposure: str = "xg_total", outcome: str = "goals_total") -> DataFrame:
    """For each of the ``pairs`` (a, b), distinct ones: the chance that a's rate is above b's.

    Each key's distribution is built once. A pair takes a's points, ``2 SIDE_POINTS``
    of them, and reads what b has below each from b's array; a's points lie on both sides of b's mode.
    """
    of, names = distribution(rows, key, exposure, outcome), ("s", "g", "m", "sd", "upto")
    sides = [of.select(F.col(key).alias(n), *(F.col(f"__{c}").alias(f"__{c}_{x}") for c in names)) for n, x in ((a, "a"), (b, "b"))]
    both = pairs.select(a, b).join(sides[0], a).join(sides[1], b)
    # Offsets from a's mode; b's are less by the distance of the modes. The range is cut at b's mode, and at b's reach.
    reach, apart = SDS * F.col("__sd_a"), F.col("__m_b") - F.col("__m_a")
    both = both.withColumns({"__apart": apart, "__cut": F.least(F.greatest(apart, -reach), reach)})
    wide = SDS * F.col("__sd_b")
    both = both.withColumns({"__lo": F.least(F.greatest(apart - wide, -reach), reach), "__hi": F.least(F.greatest(apart + wide, -reach), reach)})
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in gauss(SIDE_POINTS)))
    each = both.withColumn("__p", F.explode(points))
    x, w, lo, cut, hi = F.col("__p.x"), F.col("__p.w"), F.col("__lo"), F.col("__cut"), F.col("__hi")
    parts = {"__d1": (lo + (cut - lo) * x, w * (cut - lo)), "__d2": (cut + (hi - cut) * x, w * (hi - cut))}
    each = each.withColumns({n: d for n, (d, _) in parts.items()})
    won = sum((width * _density(F.col(n), "_a") * _below(F.col(n) - F.col("__apart"), "_b") for n, (_, width) in parts.items()), F.lit(0.0))
    sums = each.groupBy(a, b, "__s_a", "__g_a", "__m_a", "__sd_a", "__upto_a", "__upto_b", "__hi").agg(F.sum(won).alias("__won"))
    all_a, all_b = F.element_at("__upto_a", -1), F.element_at("__upto_b", -1)
    # Above b's reach, a has won.
    beyond = all_a - _below(F.col("__hi"), "_a")
    return sums.select(a, b, rounded((F.col("__won") / all_b + beyond) / all_a, 4).alias("p_superior"))
