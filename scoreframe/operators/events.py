"""Event filters, per-entity aggregates and the classifications drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions.numbers import exact_sum, filled, ratio, rounded

#: What styles and efficiencies are called.
STYLES = ("high_volume_attacker", "low_volume_player", "balanced_player")
EFFICIENCIES = ("clinical_finisher", "underperforming", "average_finisher")
COUNTERS = ("assists", "key_passes", "progressive_passes", "pressures", "tackles", "interceptions", "dribbles")
#: Per-90 names of the ten metrics.
METRICS = {"shots": "shots_per90", "xg_total": "xg_per90", "goals_total": "goals_per90", **{c: f"{c}_per90" for c in COUNTERS}}


def involving(matches: DataFrame, who, home: str = "home", away: str = "away") -> DataFrame:
    """Matches where ``who`` plays at home or away."""
    return matches.where((F.col(home) == who) | (F.col(away) == who))


def in_matches(events: DataFrame, matches: DataFrame, on: str = "match_id") -> DataFrame:
    """Events of the given matches; a match listed twice changes nothing."""
    return events.join(matches.select(on), on, "left_semi")


def shot_rows(events: DataFrame, shot: str = "is_shot") -> DataFrame:
    """Shots with exposure (null and NaN count 0) and outcome 0 or 1."""
    return events.where(F.col(shot)).withColumns({"exposure": filled(F.col("exposure")), "outcome": F.coalesce("outcome", F.lit(0))})


def roster(events: DataFrame, team, entity: str = "entity") -> DataFrame:
    """Distinct non-null entities with an event for ``team``."""
    return events.where((F.col("team") == team) & F.col(entity).isNotNull()).select(entity).distinct()


def shot_features(shots: DataFrame, *keys: str, factor: float = 1.0) -> DataFrame:
    """Sum of exposure and outcome, count, outcome a shot and exposure a shot; keys without shots are absent."""
    sums = shots.groupBy(*keys).agg((exact_sum(F.col("exposure")) * factor).alias("xg_total"), F.sum("outcome").cast("long").alias("goals_total"), F.count(F.lit(1)).alias("shots"))
    return sums.withColumns({"conversion_rate": F.col("goals_total") / F.col("shots"), "avg_xg_per_shot": F.col("xg_total") / F.col("shots")})


def activity_counters(events: DataFrame, *keys: str) -> DataFrame:
    """Minutes (90 for each match with an event) and the seven counters of true flags."""
    return events.groupBy(*keys).agg((90 * F.count_distinct("match_id")).alias("minutes"), *(F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in COUNTERS))


def per90(rows: DataFrame, minutes: str = "minutes") -> DataFrame:
    """A per-90 value for each metric; 0 where minutes are null or not positive, or the metric is missing."""
    return rows.withColumns({new: rounded(ratio(F.coalesce(F.col(old), F.lit(0)).cast("double"), F.col(minutes)) * 90) for old, new in METRICS.items()})


def style() -> Column:
    """From shots and xg_total."""
    return F.when((F.col("shots") > 10) & (F.col("xg_total") > 5), "high_volume_attacker").when(F.col("shots") < 5, "low_volume_player").otherwise("balanced_player")


def efficiency(basis: str = "shots") -> Column:
    """From outcomes a shot, or with ``basis='exposure'`` from outcomes a unit of exposure."""
    value = F.col("conversion_rate") if basis == "shots" else ratio(F.col("goals_total").cast("double"), F.col("xg_total"))
    return F.when(value > 1.2, "clinical_finisher").when(value < 0.8, "underperforming").otherwise("average_finisher")


def feature_scale(features: DataFrame) -> DataFrame:
    """xg_total and shots divided by 10, other columns as they are."""
    return features.withColumns({"xg_total": F.col("xg_total") / 10, "shots": F.col("shots") / 10})


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """One column for each default: the row's value, or the default where it is null or the column is absent."""
    return rows.select(*(F.coalesce(F.col(c), F.lit(d)).alias(c) if c in rows.columns else F.lit(d).alias(c) for c, d in defaults.items()))


#: The profile's fields and what stands in for a missing one.
PROFILE_DEFAULTS = {
    "player": "Unknown", "profit": 0.0, "probability": 0.0, "style": "balanced_player", "efficiency": "average", "minutes": 0, "shots": 0, "xg_total": 0.0,
    "goals": 0, "assists": 0, "dribbles": 0, "key_passes": 0, "progressive_passes": 0, "pressures": 0, "tackles": 0, "interceptions": 0,
}

#: Archetype rules in order; all bounds are "at least", per 90.
ARCHETYPES = (
    ("pressing_forward", {"shots_per90": 2, "pressures_per90": 6}),
    ("box_poacher", {"xg_per90": 0.45, "shots_per90": 2.5}),
    ("vertical_creator", {"progressive_passes_per90": 4, "key_passes_per90": 1.5}),
    ("possession_controller", {"progressive_passes_per90": 6}),
    ("ball_winning_6", {"tackles_per90": 2, "interceptions_per90": 1}),
    ("transition_monster", {"dribbles_per90": 3, "shots_per90": 1.5}),
    ("touchline_winger", {"dribbles_per90": 4, "assists_per90": 0.2}),
    ("deep_playmaker", {"progressive_passes_per90": 7, "key_passes_per90": 1}),
    ("inverted_creator", {"shots_per90": 1.8, "key_passes_per90": 1.5}),
    ("elite_progressor", {"progressive_passes_per90": 8}),
)


def archetypes(rows: DataFrame) -> DataFrame:
    """``rows`` (per 90) with archetypes (all that fit, in order), primary and secondary; none fits: balanced_player."""

    def fits(bounds: dict) -> Column:
        out = F.lit(True)
        for name, least in bounds.items():
            out = out & (F.col(name) >= least)
        return out

    found = F.filter(F.array(*(F.when(fits(b), n) for n, b in ARCHETYPES)), lambda x: x.isNotNull())
    return rows.withColumn("__found", found).withColumns({
        "archetypes": F.when(F.size("__found") == 0, F.array(F.lit("balanced_player"))).otherwise(F.col("__found")),
        "primary": F.coalesce(F.get("__found", F.lit(0)), F.lit("balanced_player")),
        "secondary": F.slice("__found", 2, len(ARCHETYPES)),
    }).drop("__found")
