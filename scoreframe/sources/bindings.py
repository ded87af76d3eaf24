"""The roles that generic tables play: event log, matches with events, candidates, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions.numbers import exact_sum, rounded
from scoreframe.operators import events, rates
from scoreframe.sources.tables import table

#: Fixed values of the bindings.
PURCHASE, SHOT_TYPES = "purchase", ("click", "purchase")
STRATEGY_WORDS = {"rentable": "thing", "offensif": "thble", "efficace": "erble", "low_risk": "thtion", "polyvalent": "nicht"}


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as an event log: entity, match_id, and one flag for each activity."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    shot = kind.isin(*SHOT_TYPES)
    return table(spark, folder, "events").select(
        F.col("user_id").alias("entity"), F.date_trunc("week", "ts").alias("match_id"), "event_type",
        shot.alias("is_shot"), (F.col("value") / 100).alias("exposure"), (kind == PURCHASE).cast("int").alias("outcome"),
        ((kind == "view") & (k >= 95)).alias("assists"), (~shot & (k >= 80)).alias("key_passes"),
        kind.isin("view", "signup", "error").alias("progressive_passes"), kind.isin("error", "signup").alias("pressures"),
        (kind == "signup").alias("tackles"), ((kind == "signup") & (k >= 60)).alias("interceptions"), (kind == "error").alias("dribbles"),
    )


def match_table(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as matches: match_id, season, status, home nation."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("match_id"), F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("status"), F.col("c_nationkey").alias("home"))


def match_events(spark: SparkSession, folder: str, tolerant: bool = False) -> DataFrame:
    """``lineitem`` as events of matches: entity is the supplier, team the customer's nation; ``tolerant`` skips files of events that can't be read."""
    line, supplier = table(spark, folder, "lineitem", tolerant), table(spark, folder, "supplier")
    joined = line.join(match_table(spark, folder), F.col("l_orderkey") == F.col("match_id")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        "match_id", "season", "status", "home", F.col("s_nationkey").alias("away"), F.col("home").alias("team"), F.col("l_suppkey").alias("entity"),
        F.col("l_linenumber").alias("line"), F.col("l_discount").alias("exposure"), (F.col("l_returnflag") == "R").cast("int").alias("outcome"))


#: What one unit of discount counts as exposure.
EXPOSURE_FACTOR = 20.0 / 3.0


def part_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """``part`` with its lines as candidates, with the fields that the scorecards read."""
    part, line = table(spark, folder, "part"), table(spark, folder, "lineitem")
    sums = line.groupBy(F.col("l_partkey").alias("player")).agg(
        F.count(F.lit(1)).alias("shots"), (exact_sum(F.col("l_discount")) * EXPOSURE_FACTOR).alias("xg_total"),
        F.count_if(F.col("l_returnflag") == "R").alias("goals_total"), exact_sum(F.col("l_quantity")).alias("quantity"))
    wide = rates.rated(sums, "player").join(part, F.col("player") == F.col("p_partkey"))
    share = F.col("goals_total") / F.col("shots")
    features = wide.withColumn("conversion_rate", share)
    return features.select(
        "player", "shots", "xg_total", "goals_total", "probability",
        F.when(F.col("p_type").isin("PROMO", "LARGE"), "offensive_player").otherwise(events.style()).alias("style"),
        F.when(F.col("p_type") == "SMALL", "elite_finisher").otherwise(events.efficiency()).alias("efficiency"),
        (F.lit(16) + F.col("p_size") % 20).alias("age"), ((F.col("p_retailprice") - 900) * 1.2).alias("market_value"),
        (F.col("player") % 5).cast("int").alias("contract_years_left"), rounded(F.col("quantity") / F.col("shots") - 14).alias("salary"),
        F.when(share < 0.30, "low").when(share < 0.38, "medium").otherwise("high").alias("injury_risk"),
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """User turns of ``conversations`` as text requests."""
    return table(spark, folder, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
