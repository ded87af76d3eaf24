"""Composites: players of the event log, candidate board, squads and their needs, answered requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.functions.numbers import exact_sum, rounded
from scoreframe.operators import events, ranking, rates, rules, squad, strategies
from scoreframe.plans import scorecards
from scoreframe.sources import bindings, stored

#: Costs that split the signs of the event log's profits, and the profit of a unit of exposure.
TRANSFER_COST, SALARY_COST, VALUE_FACTOR = 120.0, 15.0, 10.0


def log_features(spark: SparkSession, folder: str) -> DataFrame:
    return events.shot_features(events.shot_rows(bindings.event_log(spark, folder)), "entity")


def log_players(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of the event log with shots: features, style, efficiency, posterior, profit, decision."""
    features = rates.rated(log_features(spark, folder), "entity").drop("sd_rate", "edge_mass", "sd_steps")
    profit = rates.expected_profit(F.col("mean_rate"), F.col("xg_total"), F.lit(TRANSFER_COST + SALARY_COST), VALUE_FACTOR)
    return features.withColumns({"style": events.style(), "efficiency": events.efficiency(), "profit": profit}).withColumn("decision", rates.decision(F.col("profit")))


#: Raised when what a stored table holds changes for the same input.
FORM = 1


def ranked_players(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`log_players` with rank within style and place among all, ranked once for each version of ``events`` and read again since."""
    of = f"{FORM}_{stored.version(spark, f'{folder}/events.parquet')}"
    return stored.stored(spark, "ranked_players", of, lambda: ranking.placed(log_players(spark, folder), "entity", "style"))


def stored_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Matches in a folder a season, so that a scan of some seasons reads no others."""
    of = f"{FORM}_{stored.version(spark, f'{folder}/orders.parquet', f'{folder}/customer.parquet')}"
    return stored.stored(spark, "matches", of, lambda: bindings.match_table(spark, folder), partition=["season"])


def stored_match_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of matches in files by their match, so that a join with matches doesn't move them."""
    of = f"{FORM}_{stored.version(spark, *(f'{folder}/{t}.parquet' for t in ('lineitem', 'orders', 'customer', 'supplier')))}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return stored.stored(spark, f"match_events_{buckets}", of, lambda: bindings.match_events(spark, folder), buckets=(buckets, "match_id"))


def log_per90(spark: SparkSession, folder: str) -> DataFrame:
    """Every entity of the event log with its counters and per-90 values; entities without shots count 0."""
    log = bindings.event_log(spark, folder)
    both = log.groupBy("entity").agg(
        (90 * F.count_distinct("match_id")).alias("minutes"), *(F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in events.COUNTERS),
        F.count_if("is_shot").alias("shots"), exact_sum(F.when(F.col("is_shot"), F.col("exposure"))).alias("xg_total"), F.coalesce(F.sum(F.when(F.col("is_shot"), F.col("outcome"))), F.lit(0)).alias("goals_total"))
    return events.per90(both)


def rejected_matches(happened: DataFrame) -> DataFrame:
    """match_id and reason of the matches whose sums of exposure and outcome allow no rate."""
    sums = happened.groupBy("match_id").agg(exact_sum(F.col("exposure")).alias("exposure"), F.sum("outcome").alias("outcome"))
    return rates.quality(sums, "match_id", "exposure", "outcome")


def scored_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as candidates through fit, market and transfer."""
    rows = bindings.part_candidates(spark, folder)
    done = reduce(rules.scored, (scorecards.TACTICAL_FIT, scorecards.MARKET, scorecards.TRANSFER), rows)
    risk = F.when(F.col("transfer_score") >= scorecards.TRANSFER_RISK[0][0], scorecards.TRANSFER_RISK[0][1]).when(F.col("transfer_score") >= scorecards.TRANSFER_RISK[1][0], scorecards.TRANSFER_RISK[1][1]).otherwise("HIGH")
    return done.withColumn("transfer_risk", risk)


def scenario_rows(candidates: DataFrame) -> DataFrame:
    """Each candidate under each scenario, without a shuffle: player, scenario, score, level, reasons."""
    cards = [scorecards.scenario(n) for n in scorecards.SCENARIOS]
    each = F.array(*(F.struct(F.lit(c.name).alias("scenario"), c.score().alias("score"), c.level(c.score()).alias("level"), c.reasons().alias("reasons")) for c in cards))
    return candidates.select("player", F.explode(each).alias("s")).select("player", "s.scenario", "s.score", "s.level", "s.reasons")


def candidate_board(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate with all scores and levels, one column for each scenario."""
    rows = reduce(rules.scored, (scorecards.scenario(n) for n in scorecards.SCENARIOS), scored_candidates(spark, folder))
    return rows.select("player", "tactical_fit_score", "tactical_fit_level", "market_score", "market_level", "transfer_score", "transfer_level", "transfer_risk", *(f"{n}_{part}" for n in scorecards.SCENARIOS for part in ("score", "level")))


def supplier_players(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as players of the squads of their nations (away), over all matches."""
    return events.shot_features(bindings.match_events(spark, folder), "away", "entity", factor=bindings.EXPOSURE_FACTOR)


def squad_report(spark: SparkSession, folder: str) -> DataFrame:
    return squad.totals(supplier_players(spark, folder), "away")


#: Bounds that split the suppliers' squads.
SQUAD_BOUNDS = {"conversion": 0.33, "offensive": 4, "xg": 8000.0}


def squad_board(spark: SparkSession, folder: str) -> DataFrame:
    """Each squad's totals, mean probability and profit of its players, how many are worth their cost, how many of each style and efficiency, gaps and needs."""
    players = supplier_players(spark, folder)
    profit = rates.expected_profit(F.col("mean_rate"), F.col("xg_total"), F.lit(15.0))
    rated = rates.rated(players, "entity").withColumns({"profit": profit, "style": events.style(), "efficiency": events.efficiency()})
    kinds = {**{f"n_{x}": F.col("style") == x for x in events.STYLES}, **{f"n_{x}": F.col("efficiency") == x for x in events.EFFICIENCIES}, "n_recruit": rates.decision(F.col("profit")) == "recruit"}
    report = squad.totals(rated, "away")
    extra = rated.groupBy(F.col("away").alias("__away")).agg(F.count(F.lit(1)).alias("players"), rounded(exact_sum(F.col("probability")) / F.count(F.lit(1)), 4).alias("mean_probability"), exact_sum(F.col("profit"), 2).alias("squad_profit"), *(F.count_if(test).alias(n) for n, test in kinds.items()))
    gaps = squad.needs(squad.weaknesses(report, "away", **SQUAD_BOUNDS))
    listed = gaps.groupBy(F.col("away").alias("__gap")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position_no", "weakness", "priority", "position"))), lambda s: F.concat_ws(":", s["weakness"], s["priority"], s["position"])), "|").alias("needs"))
    return report.join(extra, F.col("away") == F.col("__away")).join(listed, F.col("away") == F.col("__gap"), "left").select("away", "team_xg", "team_goals", "team_shots", "conversion_rate", "offensive_players", "players", "mean_probability", "squad_profit", *kinds, F.coalesce("needs", F.lit("")).alias("needs"))


def asked_requests(spark: SparkSession, folder: str) -> DataFrame:
    return strategies.detected(bindings.requests(spark, folder), bindings.STRATEGY_WORDS)


def answered_requests(spark: SparkSession, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return strategies.recommended(asked_requests(spark, folder), ranked_players(spark, folder), "entity", keep=keep)
