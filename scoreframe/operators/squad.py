"""Group totals, their gaps, and what the gaps call for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions.numbers import exact_sum, ratio, rounded

#: Weakness, priority, position, profile, reason.
NEEDS = (
    ("low_creation", "HIGH", "LW", "creative_winger", "lack_of_creation"),
    ("low_efficiency", "HIGH", "ST", "clinical_finisher", "lack_of_finishing"),
    ("few_offensive_profiles", "MEDIUM", "AM/LW", "offensive_playmaker", "lack_of_profiles"),
)


def totals(players: DataFrame, *group: str, offensive_shots: int = 10) -> DataFrame:
    """team_xg, team_goals, team_shots, conversion_rate (0 without shots) and players with ``offensive_shots`` or more."""
    sums = players.groupBy(*group).agg(
        rounded(exact_sum(F.col("xg_total"))).alias("team_xg"), F.coalesce(F.sum("goals_total"), F.lit(0)).alias("team_goals"),
        F.coalesce(F.sum("shots"), F.lit(0)).alias("team_shots"), F.count_if(F.col("shots") >= offensive_shots).alias("offensive_players"))
    return sums.withColumn("conversion_rate", rounded(ratio(F.col("team_goals").cast("double"), F.col("team_shots"))))


def weaknesses(report: DataFrame, *group: str, conversion: float = 0.18, offensive: int = 3, xg: float = 8.0) -> DataFrame:
    """A row for each gap of each group, judged on the rounded totals, in the order of ``position``."""
    found = F.array(
        F.when(F.col("conversion_rate") <= conversion, F.lit("low_efficiency")), F.when(F.col("offensive_players") <= offensive, F.lit("few_offensive_profiles")),
        F.when(F.col("team_xg") <= xg, F.lit("low_creation")))
    return report.select(*group, F.posexplode(F.filter(found, lambda x: x.isNotNull())).alias("position_no", "weakness"))


def needs_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in NEEDS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(weakness, priority, position, profile, reason)")


def needs(gaps: DataFrame) -> DataFrame:
    """The needs of the gaps; an unknown weakness has none. The joined table has three rows."""
    return gaps.join(F.broadcast(needs_table(gaps.sparkSession)), "weakness")
