"""The scorecards as data. Tests, points and levels."""

from __future__ import annotations

from scoreframe.operators.rules import Branch as B
from scoreframe.operators.rules import Scorecard

TACTICAL_FIT = Scorecard(
    "tactical_fit",
    (
        (B("style = 'offensive_player'", 3, "style_offensive"), B("style = 'balanced_player'", 2, "style_balanced"), B("style = 'low_volume_player'", 0, "style_low_volume")),
        (B("efficiency = 'elite_finisher'", 3, "efficiency_elite"), B("efficiency = 'average_finisher'", 1, "efficiency_average"), B("efficiency = 'underperforming'", -1, "efficiency_under")),
        (B("probability >= 0.70D", 3, "probability_high"), B("probability >= 0.55D", 2, "probability_good"), B("probability >= 0.40D", 1, "probability_fair")),
        (B("shots >= 20", 3, "shots_high"), B("shots >= 10", 2, "shots_good"), B("shots >= 5", 1, "shots_fair")),
        (B("xg_total >= 5", 3, "xg_high"), B("xg_total >= 2", 2, "xg_good"), B("xg_total >= 1", 1, "xg_fair")),
    ),
    ((11, "ELITE"), (8, "HIGH"), (5, "MEDIUM")),
    "LOW",
)
MARKET = Scorecard(
    "market",
    (
        (B("age >= 20 AND age <= 26", 4, "age_ideal"), B("age >= 27 AND age <= 30", 2, "age_prime"), B("age > 30", -1, "age_old")),
        (B("market_value <= 40", 4, "value_low"), B("market_value <= 80", 2, "value_fair"), B("market_value > 80", -2, "value_high")),
        (B("contract_years_left <= 1", 4, "contract_ending"), B("contract_years_left <= 2", 2, "contract_short")),
        (B("salary <= 8", 3, "salary_low"), B("salary <= 15", 1, "salary_fair"), B("salary > 15", -2, "salary_high")),
        (B("injury_risk = 'low'", 3, "injury_low"), B("injury_risk = 'medium'", 1, "injury_medium"), B("injury_risk IS NOT NULL", -3, "injury_high")),
    ),
    ((14, "ELITE OPPORTUNITY"), (10, "VERY GOOD"), (6, "GOOD")),
    "RISKY",
    defaults={"age": 25, "market_value": 50, "contract_years_left": 3, "salary": 10, "injury_risk": "medium"},
)
#: Points are hundredths.
TRANSFER = Scorecard(
    "transfer",
    (
        (B("tactical_fit_level = 'ELITE'", 25, "fit_elite"), B("tactical_fit_level = 'HIGH'", 15, "fit_high"), B("tactical_fit_level = 'MEDIUM'", 5)),
        (B("market_level = 'EXCELLENT'", 20, "market_excellent"), B("market_level = 'GOOD'", 10, "market_good"), B("market_level = 'RISKY'", -10, "market_risky")),
        (B("age >= 23 AND age <= 28", 10, "age_stable"), B("age >= 31", -15, "age_decline")),
        (B("injury_risk = 'low'", 10), B("injury_risk = 'medium'", 0), B("injury_risk = 'high'", -20, "injury_high")),
        (B("salary >= 18", -10, "salary_heavy"),),
    ),
    ((80, "SIGN"), (60, "MONITOR")),
    "AVOID",
    base=50,
    clamp=(1, 99),
)
TRANSFER_RISK = ((75, "LOW"), (55, "MEDIUM"))

_LEVELS = ((8, "PRIORITY"), (5, "INTERESTING"))
SCENARIOS = {
    "economic": ((B("age <= 24", 3, "young"),), (B("salary <= 10", 3, "cheap_salary"),), (B("contract_years_left <= 2", 2, "contract_short"),)),
    "win_now": ((B("tactical_fit_level = 'ELITE'", 4, "fit_elite"),), (B("transfer_score >= 80", 4, "likely_success"),), (B("age >= 26 AND age <= 30", 2, "prime_age"),)),
    "young_talent": ((B("age <= 22", 5, "very_young"), B("age <= 25", 3, "young")), (B("market_value < 60", 2, "affordable"),)),
    "injury_crisis": ((B("injury_risk = 'low'", 5, "robust"),), (B("tactical_fit_level IN ('HIGH', 'ELITE')", 3, "fits_now"),)),
    "star_departure": ((B("style = 'offensive_player'", 4, "offensive"),), (B("xg_total >= 8", 3, "scorer"),), (B("transfer_score >= 75", 2, "likely_success"),)),
}


def scenario(name: str) -> Scorecard:
    """A scenario's scorecard; an unknown scenario scores 0."""
    return Scorecard(name, SCENARIOS.get(name, ()), _LEVELS, "LOW_PRIORITY")
