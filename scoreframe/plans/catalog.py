"""All registered queries of the reference's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreframe.functions.numbers import rounded
from scoreframe.operators import distributions, events, ranking, rates, rules, squad, strategies
from scoreframe.plans import boards, oracles, scorecards
from scoreframe.sources import bindings, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.SQL
#: Fixed parameters of the registered queries.
YEAR, STATUS, NATION, USER, UNION_YEARS = 1997, "F", 3, 8, (1997, 1998)
#: Best entities whose neighbours are paired, as the SQL has it; the queries named ``_all`` pair every entity.
BEST = 10
#: Rows of each style that are read from the stored ranks.
TOP = 3
UNREACHABLE, CHOSEN = ["efficace", "rentable"], ["rentable", "low_risk"]


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _listed(column: str):
    return F.concat_ws("|", column).alias(column)


@query
def catalog_filter(spark, folder):
    nation, region = tables.table(spark, folder, "nation"), tables.table(spark, folder, "region")
    return tables.selected(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), ["n_nationkey", "n_name", "r_name"], r_name="ASIA")


@query
def matches_scan(spark, folder):
    orders = tables.table(spark, folder, "orders")
    return orders.where((F.col("o_orderdate") >= F.lit(f"{YEAR}-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(f"{YEAR + 1}-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == STATUS)).select("o_orderkey", "o_custkey", "o_totalprice")


@query
def season_matches(spark, folder):
    return boards.stored_matches(spark, folder).where((F.col("season") == YEAR) & (F.col("status") == STATUS)).select("match_id", "season", "home")


@query
def matches_union(spark, folder):
    matches = bindings.match_table(spark, folder)
    return tables.stacked(*(matches.where(F.col("season") == y) for y in UNION_YEARS))


@query
def events_in_matches(spark, folder):
    matches = bindings.match_table(spark, folder).where((F.col("season") == YEAR) & (F.col("status") == STATUS))
    return events.in_matches(bindings.match_events(spark, folder), matches).select("match_id", "line", "entity", "outcome")


@query
def stored_events_in_matches(spark, folder):
    matches = boards.stored_matches(spark, folder).where((F.col("season") == YEAR) & (F.col("status") == STATUS))
    return events.in_matches(boards.stored_match_events(spark, folder), matches).select("match_id", "line", "entity", "outcome")


@query
def match_quality(spark, folder):
    return boards.rejected_matches(bindings.match_events(spark, folder, tolerant=True))


@query
def events_in_good_matches(spark, folder):
    happened = bindings.match_events(spark, folder, tolerant=True)
    return happened.join(boards.rejected_matches(happened), "match_id", "left_anti").select("match_id", "line", "entity", "outcome")


@query
def entity_events(spark, folder):
    return bindings.event_log(spark, folder).where(F.col("entity") == USER).select("entity", "event_type", "is_shot", rounded(F.col("exposure"), 4).alias("exposure"), "outcome")


@query
def candidates_source(spark, folder):
    return bindings.part_candidates(spark, folder).select("player", "style", "efficiency", "probability", "shots", rounded(F.col("xg_total"), 4).alias("xg_total"), "age", rounded(F.col("market_value"), 4).alias("market_value"), "contract_years_left", "salary", "injury_risk")


@query
def involving_filter(spark, folder):
    return events.involving(bindings.match_events(spark, folder), NATION).select("match_id", "home", "away").distinct()


@query
def team_events(spark, folder):
    return bindings.match_events(spark, folder).where(F.col("team") == NATION).select("match_id", "line", "entity", "outcome")


@query
def shot_rows(spark, folder):
    return events.shot_rows(bindings.event_log(spark, folder)).select("entity", "event_type", rounded(F.col("exposure"), 4).alias("exposure"), "outcome")


@query
def default_profile(spark, folder):
    customer, orders = tables.table(spark, folder, "customer"), tables.table(spark, folder, "orders")
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("shots"), F.count_if(F.col("o_orderstatus") == STATUS).alias("goals"))
    return events.with_defaults(customer.select(F.col("c_name").alias("player"), "c_custkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left"), events.PROFILE_DEFAULTS)


@query
def strategy_flags(spark, folder):
    return strategies.flagged(boards.log_players(spark, folder)).select("entity", *(f"is_{n}" for n in strategies.STRATEGIES))


@query
def strategy_filter(spark, folder):
    return strategies.filtered(boards.log_players(spark, folder), CHOSEN).select("entity", "profit", "probability")


@query
def strategy_fallback(spark, folder):
    return strategies.with_fallback(boards.log_players(spark, folder), UNREACHABLE).select("entity", "profit", "fallback")


@query
def strategy_relax(spark, folder):
    return strategies.relaxed(boards.log_players(spark, folder), UNREACHABLE).select("entity", "profit", "level")


@query
def roster_distinct(spark, folder):
    return events.roster(bindings.match_events(spark, folder).where(F.col("season") == YEAR), NATION)


@query
def roster_stats(spark, folder):
    season = bindings.match_events(spark, folder).where(F.col("season") == YEAR)
    chosen = season.join(events.roster(season, NATION), "entity", "left_semi")
    return events.shot_features(chosen, "entity", factor=bindings.EXPOSURE_FACTOR).select("entity", rounded(F.col("xg_total"), 4).alias("xg_total"), "goals_total", "shots", rounded(F.col("conversion_rate"), 4).alias("conversion_rate"))


@query
def needs_lookup(spark, folder):
    return squad.needs(squad.weaknesses(boards.squad_report(spark, folder), "away", **boards.SQUAD_BOUNDS))


@query
def pair_compare(spark, folder):
    return ranking.judged(ranking.neighbours(boards.ranked_players(spark, folder), "entity", ranking.COMPARED, n=BEST))


@query
def pair_compare_all(spark, folder):
    return ranking.judged(ranking.neighbours(boards.ranked_players(spark, folder), "entity", ranking.COMPARED))


@query
def scenario_cross(spark, folder):
    return boards.scenario_rows(boards.scored_candidates(spark, folder)).select("player", "scenario", "score", "level", _listed("reasons"))


@query
def request_recommend(spark, folder):
    return boards.answered_requests(spark, folder).select("conv_id", "turn", _listed("strategies"), "entity", "profit", "fallback")


@query
def request_relax(spark, folder):
    found = strategies.relaxed_requests(boards.asked_requests(spark, folder), boards.ranked_players(spark, folder), "entity")
    return found.select("conv_id", "turn", _listed("strategies"), "level", _listed("strategies_left"), F.col("n").alias("rows"), "entity", "profit")


@query
def shot_features(spark, folder):
    return boards.log_features(spark, folder).select("entity", rounded(F.col("xg_total"), 4).alias("xg_total"), "goals_total", "shots", rounded(F.col("conversion_rate"), 4).alias("conversion_rate"), rounded(F.col("avg_xg_per_shot"), 4).alias("avg_xg_per_shot"))


@query
def activity_counters(spark, folder):
    return events.activity_counters(bindings.event_log(spark, folder), "entity")


@query
def rate_posterior(spark, folder):
    return rates.rate_posterior(boards.log_features(spark, folder), "entity").select("entity", "mean_rate", "probability")


@query
def rate_posterior_parts(spark, folder):
    return bindings.part_candidates(spark, folder).select("player", "probability")


@query
def posterior_summary(spark, folder):
    return rates.posterior_summary(boards.log_features(spark, folder), "entity")


@query
def expected_profit(spark, folder):
    return boards.log_players(spark, folder).select("entity", "profit")


@query
def decide_sign(spark, folder):
    return boards.log_players(spark, folder).select("entity", "decision", "probability", "profit")


@query
def squad_totals(spark, folder):
    return boards.squad_report(spark, folder)


@query
def squad_weaknesses(spark, folder):
    return squad.weaknesses(boards.squad_report(spark, folder), "away", **boards.SQUAD_BOUNDS)


@query
def funnel_counts(spark, folder):
    players = strategies.flagged(boards.log_players(spark, folder))
    matches = events.shot_rows(bindings.event_log(spark, folder)).agg(F.count_distinct("match_id").alias("matches"))
    return matches.crossJoin(players.agg(F.count(F.lit(1)).alias("analysed"), F.count_if("is_rentable").alias("profitable"), F.count_if(F.col("is_rentable") & F.col("is_low_risk")).alias("kept")))  # a row each


@query
def rank_by_profit(spark, folder):
    return boards.ranked_players(spark, folder).select("style", "entity", "profit", "rank")


@query
def topk_reuse(spark, folder):
    return boards.ranked_players(spark, folder).where(F.col("rank") <= TOP).select("style", "rank", "place", "entity", "profit")


@query
def recommend_top1(spark, folder):
    return boards.ranked_players(spark, folder).where(F.col("rank") == 1).select("style", "entity", "profit", ranking.message(F.col("profit")).alias("message"))


@query
def first_n(spark, folder):
    return ranking.first_n(boards.ranked_players(spark, folder), "entity", 50).select("entity", "profit")


@query
def per90(spark, folder):
    return boards.log_per90(spark, folder).select("entity", "minutes", *events.METRICS.values())


@query
def infer_style(spark, folder):
    return boards.log_features(spark, folder).select("entity", events.style().alias("style"))


@query
def infer_efficiency(spark, folder):
    return boards.log_features(spark, folder).select("entity", events.efficiency().alias("efficiency"), events.efficiency("exposure").alias("efficiency_by_exposure"))


@query
def feature_scale(spark, folder):
    return events.feature_scale(boards.log_features(spark, folder)).select("entity", rounded(F.col("xg_total"), 4).alias("xg_total"), "shots", "goals_total")


@query
def build_profile(spark, folder):
    features = boards.log_features(spark, folder).withColumns({"style": events.style(), "efficiency": events.efficiency()})
    return features.select("entity", "style", "efficiency", rounded(F.col("xg_total"), 4).alias("xg_total"), "goals_total", "shots")


@query
def archetypes(spark, folder):
    return events.archetypes(boards.log_per90(spark, folder)).select("entity", _listed("archetypes"), "primary", _listed("secondary"))


def _card(name: str):
    def run(spark, folder):
        return boards.scored_candidates(spark, folder).select("player", f"{name}_score", f"{name}_level", _listed(f"{name}_reasons"))

    return run


QUERIES["tactical_fit"], QUERIES["market_score"] = _card("tactical_fit"), _card("market")


@query
def transfer_success(spark, folder):
    return boards.scored_candidates(spark, folder).select("player", (F.col("transfer_score") / 100).alias("probability"), F.col("transfer_level").alias("decision"), F.col("transfer_risk").alias("risk"), _listed("transfer_reasons"))


def _scenario(name: str):
    def run(spark, folder):
        return rules.scored(boards.scored_candidates(spark, folder), scorecards.scenario(name)).select("player", f"{name}_score", f"{name}_level", _listed(f"{name}_reasons"))

    return run


for _name in scorecards.SCENARIOS:
    QUERIES[f"scenario_{_name}"] = _scenario(_name)


@query
def detect_strategies(spark, folder):
    return strategies.detected(bindings.requests(spark, folder), bindings.STRATEGY_WORDS).select("conv_id", "turn", _listed("strategies"))


@query
def reason_codes(spark, folder):
    found = strategies.detected(bindings.requests(spark, folder), bindings.STRATEGY_WORDS)
    return found.select("conv_id", "turn", F.concat_ws("|", strategies.reason_codes(F.col("strategies"))).alias("reasons"))


@query
def explanation_text(spark, folder):
    percent = F.floor(F.col("probability") * 100 + 0.5).cast("string")
    said = F.concat(F.lit("entity "), F.col("entity").cast("string"), F.lit(": expected profit "), F.col("profit").cast("decimal(18,2)").cast("string"), F.lit(", chance "), percent, F.lit("%, style "), F.col("style"))
    return boards.log_players(spark, folder).select("entity", said.alias("explanation"))


def _said(pairs):
    said = F.concat(F.lit("profit: "), F.col("more_profit").cast("string"), F.lit(", probability: "), F.col("more_probable").cast("string"), F.lit(", styles: "), F.col("style_a"), F.lit(" / "), F.col("style_b"))
    return pairs.select("a", "b", said.alias("comparison"))


@query
def comparison_text(spark, folder):
    return _said(pair_compare(spark, folder))


@query
def comparison_text_all(spark, folder):
    return _said(pair_compare_all(spark, folder))


@query
def response_text(spark, folder):
    return strategies.response(boards.answered_requests(spark, folder), "entity").select("conv_id", "turn", "response")


@query
def posterior_superiority(spark, folder):
    features = boards.ranked_players(spark, folder)
    return rates.superiority(ranking.neighbours(boards.ranked_players(spark, folder), "entity", [], n=BEST), features, "entity")


@query
def posterior_superiority_all(spark, folder):
    features = boards.ranked_players(spark, folder)
    return rates.superiority(ranking.neighbours(features, "entity", []), features, "entity")


@query
def group_superiority(spark, folder):
    log = tables.table(spark, folder, "events")
    kinds = log.select(F.col("event_type").alias("a")).distinct()
    later = F.collect_list("a").over(Window.orderBy("a").rowsBetween(1, Window.unboundedFollowing))  # a row a kind
    pairs = kinds.where("a IS NOT NULL").withColumn("later", later).select("a", F.explode("later").alias("b"))
    return distributions.group_superiority(log, pairs, "event_type", "value")


@query
def tail_profile(spark, folder):
    return distributions.tail_profile(tables.table(spark, folder, "events"), "event_type", "value")


@query
def candidate_board(spark, folder):
    return boards.candidate_board(spark, folder)


@query
def squad_board(spark, folder):
    return boards.squad_board(spark, folder)


@query
def request_board(spark, folder):
    kept = ("style", "efficiency", "probability", "decision")
    answered = strategies.response(boards.answered_requests(spark, folder, kept), "entity")
    return answered.select("conv_id", "turn", _listed("strategies"), "entity", "profit", "fallback", *kept, "response")
