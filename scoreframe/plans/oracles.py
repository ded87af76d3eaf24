"""DuckDB SQL for the registered queries, written from the rule tables.

Queries are put together from common table expressions: the event log's features
and posterior, the candidates' scores, the matches' events.
"""

from __future__ import annotations

import numpy as np


def _r(x: str, digits: int = 2) -> str:
    return f"(CASE WHEN abs(({x})::DOUBLE) < 9007199254740992::DOUBLE / 1e{digits}::DOUBLE THEN floor(({x}) * 1e{digits}::DOUBLE + 0.5::DOUBLE) / 1e{digits}::DOUBLE ELSE ({x})::DOUBLE END)"


LOG = """
log AS (
  SELECT user_id AS entity, date_trunc('week', ts) AS match_id, event_type, event_type IN ('click', 'purchase') AS is_shot,
         value / 100 AS exposure, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS outcome,
         regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k
  FROM events
), features AS (
  SELECT *, goals_total / shots::DOUBLE AS conversion_rate, xg_total / shots AS avg_xg_per_shot FROM (
    SELECT entity, sum(exposure::DECIMAL(18,4))::DOUBLE AS xg_total, sum(outcome)::BIGINT AS goals_total, count(*) AS shots
    FROM log WHERE is_shot GROUP BY entity)
)"""


def _gauss(points: int) -> str:
    """A table of Gauss-Legendre places x and weights q on (0, 1)."""
    x, w = np.polynomial.legendre.leggauss(points)
    return "(VALUES " + ", ".join(f"({(1 + a) / 2!r}::DOUBLE, {b / 2!r}::DOUBLE)" for a, b in zip(x.tolist(), w.tolist(), strict=True)) + ") gauss(x, q)"


def _f(d: str) -> str:
    """The posterior's density at mode + d over that at the mode."""
    return f"exp(g * ({d}) - s * exp(m) * (exp({d}) - 1) - 2 * (({d}) + 2 * m) * ({d}))"


def _modes(name: str, source: str, key: str) -> str:
    """Mode and standard deviation of each key's log rate, by Newton's steps from a bound above it."""
    start = "CASE WHEN s = 0 THEN 0 WHEN g > s THEN least(g / 4, ln(g / s)) ELSE least(0, ln((g + 4 * greatest(ln(s / greatest(g, 1)), 0.25::DOUBLE)) / s)) END"
    steps = [f"{name}_mode0 AS (SELECT {key}, s, g, {start} AS m FROM (SELECT {key}, xg_total::DOUBLE AS s, goals_total::DOUBLE AS g FROM {source} WHERE NOT (xg_total = 0 AND goals_total > 0)))"]
    steps += [f"{name}_mode{k} AS (SELECT {key}, s, g, m - (s * exp(m) + 4 * m - g) / (s * exp(m) + 4) AS m FROM {name}_mode{k - 1})" for k in range(1, 9)]
    return ",\n".join([*steps, f"{name}_mode AS (SELECT *, 8 / sqrt(s * exp(m) + 4) AS reach FROM {name}_mode8)"])


def _posterior(name: str, source: str, key: str) -> str:
    return f"""
{_modes(name, source, key)},
{name}_points AS (
  SELECT *, q * (cut + reach) * {_f("down")} AS w_down, q * (reach - cut) * {_f("up")} AS w_up
  FROM (SELECT *, (cut + reach) * x - reach AS down, cut + (reach - cut) * x AS up FROM (SELECT *, least(greatest(-m, -reach), reach) AS cut FROM {name}_mode), {_gauss(26)})
), {name} AS (
  SELECT {key}, {_r("sum(w_down * exp(m + down) + w_up * exp(m + up)) / sum(w_down + w_up)", 4)} AS mean_rate, {_r("sum(w_up) / sum(w_down + w_up)", 4)} AS probability
  FROM {name}_points GROUP BY {key}
)"""


def _ends() -> str:
    """Ends of the interval with 3 % on each side, and of the shortest one with 94 %, each key's weights integrated anew in each of Newton's steps."""
    upto = lambda end: f"sum(q * ({end} + reach) * {_f(f'({end} + reach) * x - reach')})"
    slope = lambda d: f"(g - s * exp(m) * exp({d}) - 4 * (({d}) + m))"
    parts = [f"whole AS (SELECT *, -reach / 4.2::DOUBLE AS lo, reach / 4.2::DOUBLE AS hi FROM (SELECT entity, s, g, m, reach, {upto('reach')} AS w FROM posterior_mode, {_gauss(48)} GROUP BY ALL))"]
    last = "whole"
    for k in range(7):
        step = lambda end, share: f"greatest(-reach, least(reach, {end} + greatest(-reach / 8, least(reach / 8, ({share}::DOUBLE * w - {upto(end)}) / {_f(end)})))) AS {end}"
        parts.append(f"tails{k} AS (SELECT entity, s, g, m, reach, w, {step('lo', 0.03)}, {step('hi', 0.97)} FROM (SELECT *, lo AS l, hi AS h FROM {last}), {_gauss(48)} GROUP BY entity, s, g, m, reach, w, lo, hi)")
        last = f"tails{k}"
    parts.append(f"dense0 AS (SELECT *, lo AS a, hi AS b FROM {last})")
    for k in range(1, 7):
        parts.append(f"""dense{k} AS (SELECT entity, s, g, m, reach, w, lo, hi, least(0, greatest(-reach, a + (fb * even - more * lb) / (fa * lb - fb * la))) AS a, greatest(0, least(reach, b + (fa * even - more * la) / (fa * lb - fb * la))) AS b
  FROM (SELECT *, ln(fa / fb) AS even, 0.94::DOUBLE * w - held AS more FROM (SELECT entity, s, g, m, reach, w, lo, hi, a, b, {_f("a")} AS fa, {_f("b")} AS fb, {slope("a")} AS la, {slope("b")} AS lb,
    {upto("b")} - {upto("a")} AS held FROM dense{k - 1}, {_gauss(48)} GROUP BY entity, s, g, m, reach, w, lo, hi, a, b)))""")
    moments = "SELECT entity, sum(w_down * exp(m + down) + w_up * exp(m + up)) / sum(w_down + w_up) AS mean, sum(w_down * exp(m + down) ** 2 + w_up * exp(m + up) ** 2) / sum(w_down + w_up) AS second FROM posterior_points GROUP BY entity"
    return f""", {", ".join(parts)}, moments AS ({moments})
SELECT entity, {_r("mean", 4)} AS mean_rate, {_r("sqrt(greatest(second - mean * mean, 0))", 4)} AS sd_rate, {_r("exp(m + lo)", 4)} AS low, {_r("exp(m + hi)", 4)} AS high, {_r("exp(m + a)", 4)} AS densest_low, {_r("exp(m + b)", 4)} AS densest_high
FROM dense6 JOIN moments USING (entity)"""


_SUPERIORITY = f""", nodes AS (SELECT entity, s, g, m, reach, x, (2 * x - 1) * reach AS d, 2 * reach * q * {_f("(2 * x - 1) * reach")} AS p FROM posterior_mode, {_gauss(64)}),
below AS (
  SELECT a, b, x, p, sum(won) AS won FROM (
    SELECT n.a, n.b, n.x, n.p, n.span * z.q * {_f("n.span * z.x - reach")} AS won, 0
    FROM (SELECT pairs.a, pairs.b, u.x, u.p, y.s, y.g, y.m, y.reach, greatest(0, least(2 * y.reach, u.m + u.d - y.m + y.reach)) AS span
          FROM pairs JOIN nodes u ON u.entity = pairs.a JOIN posterior_mode y ON y.entity = pairs.b) n, {_gauss(64).replace("gauss(x, q)", "z(x, q)")}) GROUP BY a, b, x, p
), totals AS (SELECT entity, sum(p) AS w FROM nodes GROUP BY entity)
SELECT a, b, {_r("sum(p * won) / max(x.w) / max(y.w)", 4)} AS p_superior FROM below JOIN totals x ON x.entity = a JOIN totals y ON y.entity = b GROUP BY a, b"""


STYLE = "CASE WHEN shots > 10 AND xg_total > 5 THEN 'high_volume_attacker' WHEN shots < 5 THEN 'low_volume_player' ELSE 'balanced_player' END"
EFFICIENCY = "CASE WHEN conversion_rate > 1.2::DOUBLE THEN 'clinical_finisher' WHEN conversion_rate < 0.8::DOUBLE THEN 'underperforming' ELSE 'average_finisher' END"
PLAYERS = f"""{LOG}, {_posterior("posterior", "features", "entity")},
players AS (
  SELECT *, CASE WHEN profit > 0 THEN 'recruit' ELSE 'do_not_recruit' END AS decision FROM (
    SELECT f.*, p.mean_rate, p.probability, {_r("p.mean_rate * f.xg_total * 10 - 135")} AS profit, {STYLE} AS style, {EFFICIENCY} AS efficiency
    FROM features f JOIN posterior p USING (entity))
)"""
FLAGS = """
flags AS (
  SELECT *, profit > 0 AS is_rentable, shots >= 5 AS is_offensif, efficiency = 'clinical_finisher' AS is_efficace, probability > 0.6::DOUBLE AS is_low_risk, style = 'balanced_player' AS is_polyvalent FROM players
)"""
METRICS = ("shots", "xg", "goals", "assists", "key_passes", "progressive_passes", "pressures", "tackles", "interceptions", "dribbles")
_SUMS = {
    "shots": "count(*) FILTER (WHERE is_shot)", "xg": "coalesce(sum(CASE WHEN is_shot THEN exposure END::DECIMAL(18,4))::DOUBLE, 0)", "goals": "coalesce(sum(outcome) FILTER (WHERE is_shot), 0)",
    "assists": "count(*) FILTER (WHERE event_type = 'view' AND k >= 95)", "key_passes": "count(*) FILTER (WHERE NOT is_shot AND k >= 80)",
    "progressive_passes": "count(*) FILTER (WHERE event_type IN ('view', 'signup', 'error'))", "pressures": "count(*) FILTER (WHERE event_type IN ('error', 'signup'))",
    "tackles": "count(*) FILTER (WHERE event_type = 'signup')", "interceptions": "count(*) FILTER (WHERE event_type = 'signup' AND k >= 60)", "dribbles": "count(*) FILTER (WHERE event_type = 'error')",
}
PER90 = f"""{LOG}, counted AS (
  SELECT entity, 90 * count(DISTINCT match_id) AS minutes, {", ".join(f"{e} AS {m}" for m, e in _SUMS.items())} FROM log GROUP BY entity
), per90 AS (
  SELECT entity, minutes, {", ".join(_r(f"({m}::DOUBLE / minutes) * 90") + f" AS {m}_per90" for m in METRICS)} FROM counted
)"""
MATCHES = """
matches AS (
  SELECT o_orderkey AS match_id, year(o_orderdate) AS season, o_orderstatus AS status, c_nationkey AS home FROM orders JOIN customer ON o_custkey = c_custkey
), happened AS (
  SELECT match_id, season, status, home, s_nationkey AS away, home AS team, l_suppkey AS entity, l_linenumber AS line, l_discount AS exposure, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS outcome
  FROM lineitem JOIN matches ON l_orderkey = match_id JOIN supplier ON l_suppkey = s_suppkey
)"""
_FACTOR = "(20.0::DOUBLE / 3.0::DOUBLE)"
SQUADS = f"""{MATCHES}, members AS (
  SELECT away, entity, sum(exposure::DECIMAL(18,4))::DOUBLE * {_FACTOR} AS xg_total, sum(outcome)::BIGINT AS goals_total, count(*) AS shots FROM happened GROUP BY away, entity
), report AS (
  SELECT *, {_r("CASE WHEN team_shots > 0 THEN team_goals::DOUBLE / team_shots ELSE 0 END")} AS conversion_rate FROM (
    SELECT away, {_r("sum(xg_total::DECIMAL(18,4))::DOUBLE")} AS team_xg, sum(goals_total)::BIGINT AS team_goals, sum(shots)::BIGINT AS team_shots, count(*) FILTER (WHERE shots >= 10) AS offensive_players FROM members GROUP BY away)
), gaps AS (
  SELECT away, row_number() OVER (PARTITION BY away ORDER BY o) - 1 AS position_no, weakness FROM (
    SELECT away, 1 AS o, 'low_efficiency' AS weakness FROM report WHERE conversion_rate <= 0.33::DOUBLE
    UNION ALL SELECT away, 2, 'few_offensive_profiles' FROM report WHERE offensive_players <= 4
    UNION ALL SELECT away, 3, 'low_creation' FROM report WHERE team_xg <= 8000)
), needs AS (
  SELECT * FROM (VALUES ('low_creation', 'HIGH', 'LW', 'creative_winger', 'lack_of_creation'), ('low_efficiency', 'HIGH', 'ST', 'clinical_finisher', 'lack_of_finishing'),
    ('few_offensive_profiles', 'MEDIUM', 'AM/LW', 'offensive_playmaker', 'lack_of_profiles')) t(weakness, priority, position, profile, reason)
)"""
CANDIDATES = f"""
sums AS (
  SELECT l_partkey AS player, count(*) AS shots, sum(l_discount::DECIMAL(18,4))::DOUBLE * {_FACTOR} AS xg_total, count(*) FILTER (WHERE l_returnflag = 'R') AS goals_total, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS quantity
  FROM lineitem GROUP BY l_partkey
), {_posterior("rated", "sums", "player")},
candidates AS (
  SELECT player, shots, xg_total, probability,
    CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'offensive_player' ELSE {STYLE} END AS style, CASE WHEN p_type = 'SMALL' THEN 'elite_finisher' ELSE {EFFICIENCY} END AS efficiency,
    16 + p_size % 20 AS age, (p_retailprice - 900) * 1.2::DOUBLE AS market_value, (player % 5)::INT AS contract_years_left, {_r("quantity / shots - 14")} AS salary,
    CASE WHEN conversion_rate < 0.30::DOUBLE THEN 'low' WHEN conversion_rate < 0.38::DOUBLE THEN 'medium' ELSE 'high' END AS injury_risk
  FROM (SELECT *, goals_total / shots::DOUBLE AS conversion_rate FROM sums) JOIN rated USING (player) JOIN part ON player = p_partkey
)"""


def _score(groups: list[list[tuple[str, int, str | None]]]) -> tuple[str, str]:
    """SQL for the score and the joined reasons of (test, points, reason) groups."""
    points = " + ".join("CASE " + " ".join(f"WHEN {t} THEN {p}" for t, p, _ in g) + " ELSE 0 END" for g in groups)
    reasons = ", ".join("CASE " + " ".join(f"WHEN {t} THEN " + (f"'{r}'" if r else "NULL") for t, _, r in g) + " END" for g in groups)
    return f"({points})", f"concat_ws('|', {reasons})"


_FIT = _score([
    [("style = 'offensive_player'", 3, "style_offensive"), ("style = 'balanced_player'", 2, "style_balanced"), ("style = 'low_volume_player'", 0, "style_low_volume")],
    [("efficiency = 'elite_finisher'", 3, "efficiency_elite"), ("efficiency = 'average_finisher'", 1, "efficiency_average"), ("efficiency = 'underperforming'", -1, "efficiency_under")],
    [("probability >= 0.7::DOUBLE", 3, "probability_high"), ("probability >= 0.55::DOUBLE", 2, "probability_good"), ("probability >= 0.4::DOUBLE", 1, "probability_fair")],
    [("shots >= 20", 3, "shots_high"), ("shots >= 10", 2, "shots_good"), ("shots >= 5", 1, "shots_fair")],
    [("xg_total >= 5", 3, "xg_high"), ("xg_total >= 2", 2, "xg_good"), ("xg_total >= 1", 1, "xg_fair")],
])
_MARKET = _score([
    [("age BETWEEN 20 AND 26", 4, "age_ideal"), ("age BETWEEN 27 AND 30", 2, "age_prime"), ("age > 30", -1, "age_old")],
    [("market_value <= 40", 4, "value_low"), ("market_value <= 80", 2, "value_fair"), ("market_value > 80", -2, "value_high")],
    [("contract_years_left <= 1", 4, "contract_ending"), ("contract_years_left <= 2", 2, "contract_short")],
    [("salary <= 8", 3, "salary_low"), ("salary <= 15", 1, "salary_fair"), ("salary > 15", -2, "salary_high")],
    [("injury_risk = 'low'", 3, "injury_low"), ("injury_risk = 'medium'", 1, "injury_medium"), ("injury_risk IS NOT NULL", -3, "injury_high")],
])
_TRANSFER = _score([
    [("tactical_fit_level = 'ELITE'", 25, "fit_elite"), ("tactical_fit_level = 'HIGH'", 15, "fit_high"), ("tactical_fit_level = 'MEDIUM'", 5, None)],
    [("market_level = 'GOOD'", 10, "market_good"), ("market_level = 'RISKY'", -10, "market_risky")],
    [("age BETWEEN 23 AND 28", 10, "age_stable"), ("age >= 31", -15, "age_decline")],
    [("injury_risk = 'low'", 10, None), ("injury_risk = 'high'", -20, "injury_high")],
    [("salary >= 18", -10, "salary_heavy")],
])
_SCENARIOS = {
    "economic": _score([[("age <= 24", 3, "young")], [("salary <= 10", 3, "cheap_salary")], [("contract_years_left <= 2", 2, "contract_short")]]),
    "win_now": _score([[("tactical_fit_level = 'ELITE'", 4, "fit_elite")], [("transfer_score >= 80", 4, "likely_success")], [("age BETWEEN 26 AND 30", 2, "prime_age")]]),
    "young_talent": _score([[("age <= 22", 5, "very_young"), ("age <= 25", 3, "young")], [("market_value < 60", 2, "affordable")]]),
    "injury_crisis": _score([[("injury_risk = 'low'", 5, "robust")], [("tactical_fit_level IN ('HIGH', 'ELITE')", 3, "fits_now")]]),
    "star_departure": _score([[("style = 'offensive_player'", 4, "offensive")], [("xg_total >= 8", 3, "scorer")], [("transfer_score >= 75", 2, "likely_success")]]),
}
_LEVEL = "CASE WHEN {0} >= 8 THEN 'PRIORITY' WHEN {0} >= 5 THEN 'INTERESTING' ELSE 'LOW_PRIORITY' END"
SCORED = f"""{CANDIDATES}, fitted AS (
  SELECT *, CASE WHEN tactical_fit_score >= 11 THEN 'ELITE' WHEN tactical_fit_score >= 8 THEN 'HIGH' WHEN tactical_fit_score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS tactical_fit_level,
         CASE WHEN market_score >= 14 THEN 'ELITE OPPORTUNITY' WHEN market_score >= 10 THEN 'VERY GOOD' WHEN market_score >= 6 THEN 'GOOD' ELSE 'RISKY' END AS market_level
  FROM (SELECT *, {_FIT[0]} AS tactical_fit_score, {_FIT[1]} AS tactical_fit_reasons, {_MARKET[0]} AS market_score, {_MARKET[1]} AS market_reasons FROM candidates)
), scored AS (
  SELECT *, CASE WHEN transfer_score >= 80 THEN 'SIGN' WHEN transfer_score >= 60 THEN 'MONITOR' ELSE 'AVOID' END AS transfer_level,
         CASE WHEN transfer_score >= 75 THEN 'LOW' WHEN transfer_score >= 55 THEN 'MEDIUM' ELSE 'HIGH' END AS transfer_risk
  FROM (SELECT *, greatest(1, least(99, 50 + {_TRANSFER[0]})) AS transfer_score, {_TRANSFER[1]} AS transfer_reasons FROM fitted)
)"""
_WORDS = {"rentable": "thing", "offensif": "thble", "efficace": "erble", "low_risk": "thtion", "polyvalent": "nicht"}
_REASONS = {"rentable": "positive_expected_profit", "offensif": "offensive_volume", "efficace": "clinical_finishing", "low_risk": "high_probability"}
_HAS = {n: f"coalesce(contains(lower(text), '{w}'), false)" for n, w in _WORDS.items()}


def _listed(sep: str) -> str:
    return f"concat_ws('{sep}', " + ", ".join(f"CASE WHEN {h} THEN '{n}' END" for n, h in _HAS.items()) + ")"


def _reasons(sep: str) -> str:
    return f"coalesce(nullif(concat_ws('{sep}', " + ", ".join(f"CASE WHEN {_HAS[n]} THEN '{r}' END" for n, r in _REASONS.items()) + "), ''), 'no_exact_match')"


_WANTED = " + ".join(f"CASE WHEN {h} THEN {1 << i} ELSE 0 END" for i, h in enumerate(_HAS.values()))
ANSWERED = f"""{PLAYERS}, {FLAGS}, bits AS (
  SELECT *, {" + ".join(f"CASE WHEN is_{n} THEN {1 << i} ELSE 0 END" for i, n in enumerate(_WORDS))} AS bits FROM flags
), best AS (
  SELECT set, entity, profit FROM (
    SELECT s.set, b.entity, b.profit, row_number() OVER (PARTITION BY s.set ORDER BY b.profit DESC, b.entity) AS n FROM bits b, range(0, 32) s(set) WHERE (b.bits & s.set) = s.set) WHERE n = 1
), asked AS (
  SELECT conv_id, turn, text, {_listed("|")} AS strategies, {_WANTED} AS wanted FROM conversations WHERE role = 'user'
), answered AS (
  SELECT a.*, coalesce(b.entity, e.entity) AS entity, coalesce(b.profit, e.profit) AS profit, b.entity IS NULL AS fallback
  FROM asked a LEFT JOIN best b ON a.wanted = b.set LEFT JOIN best e ON e.set = 0
)"""
_RESPONSE = f"""concat_ws(chr(10), 'recommended: ' || entity, 'criteria: ' || coalesce(nullif({_listed(", ")}, ''), 'none'), 'reasons: ' || {_reasons(", ")}, CASE WHEN fallback THEN 'note: no row meets all criteria' END)"""
PAIRS = f"""{PLAYERS}, pairs AS (
  SELECT entity AS a, b FROM (SELECT entity, n, lead(entity) OVER (ORDER BY n) AS b FROM (SELECT entity, row_number() OVER (ORDER BY profit DESC, entity) AS n FROM players) WHERE n <= 10) WHERE b IS NOT NULL
), compared AS (
  SELECT a, b, CASE WHEN x.profit > y.profit THEN a ELSE b END AS more_profit, CASE WHEN x.probability > y.probability THEN a ELSE b END AS more_probable, x.style AS style_a, y.style AS style_b
  FROM pairs JOIN players x ON x.entity = a JOIN players y ON y.entity = b
)"""
_UNREACHABLE, _LOOSE = "efficiency = 'clinical_finisher' AND profit > 0", "efficiency = 'clinical_finisher'"


def _with(common: str, select: str) -> str:
    if select.startswith(","):  # more common table expressions
        return f"WITH {common.strip()}{select}"
    return f"WITH {common.strip()}\n{select}"


def _archetype_sql() -> str:
    rules = [
        ("pressing_forward", "shots_per90 >= 2 AND pressures_per90 >= 6"), ("box_poacher", "xg_per90 >= 0.45::DOUBLE AND shots_per90 >= 2.5::DOUBLE"),
        ("vertical_creator", "progressive_passes_per90 >= 4 AND key_passes_per90 >= 1.5::DOUBLE"), ("possession_controller", "progressive_passes_per90 >= 6"),
        ("ball_winning_6", "tackles_per90 >= 2 AND interceptions_per90 >= 1"), ("transition_monster", "dribbles_per90 >= 3 AND shots_per90 >= 1.5::DOUBLE"),
        ("touchline_winger", "dribbles_per90 >= 4 AND assists_per90 >= 0.2::DOUBLE"), ("deep_playmaker", "progressive_passes_per90 >= 7 AND key_passes_per90 >= 1"),
        ("inverted_creator", "shots_per90 >= 1.8::DOUBLE AND key_passes_per90 >= 1.5::DOUBLE"), ("elite_progressor", "progressive_passes_per90 >= 8"),
    ]
    joined = "concat_ws('|', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in rules) + ")"
    return _with(PER90, f"""SELECT entity, coalesce(nullif(j, ''), 'balanced_player') AS archetypes, CASE WHEN j = '' THEN 'balanced_player' ELSE split_part(j, '|', 1) END AS "primary",
       CASE WHEN instr(j, '|') > 0 THEN substr(j, instr(j, '|') + 1) ELSE '' END AS secondary FROM (SELECT entity, {joined} AS j FROM per90)""")


_FEATURES = f"entity, {_r('xg_total', 4)} AS xg_total, goals_total, shots"
SQL: dict[str, str] = {
    "catalog_filter": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "matches_scan": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus = 'F'",
    "season_matches": _with(MATCHES, "SELECT match_id, season, home FROM matches WHERE season = 1997 AND status = 'F'"),
    "stored_events_in_matches": _with(MATCHES, "SELECT match_id, line, entity, outcome FROM happened WHERE season = 1997 AND status = 'F'"),
    "matches_union": _with(MATCHES, "SELECT * FROM matches WHERE season = 1997 UNION ALL SELECT * FROM matches WHERE season = 1998"),
    "events_in_matches": _with(MATCHES, "SELECT match_id, line, entity, outcome FROM happened WHERE season = 1997 AND status = 'F'"),
    "match_quality": _with(MATCHES, "SELECT match_id, 'outcome_without_exposure' AS reason FROM happened GROUP BY match_id HAVING sum(exposure::DECIMAL(18,4)) = 0 AND sum(outcome) > 0"),
    "events_in_good_matches": _with(MATCHES, "SELECT match_id, line, entity, outcome FROM happened WHERE match_id NOT IN (SELECT match_id FROM happened GROUP BY match_id HAVING sum(exposure::DECIMAL(18,4)) = 0 AND sum(outcome) > 0)"),
    "entity_events": _with(LOG, f"SELECT entity, event_type, is_shot, {_r('exposure', 4)} AS exposure, outcome FROM log WHERE entity = 8"),
    "candidates_source": _with(CANDIDATES, f"SELECT player, style, efficiency, probability, shots, {_r('xg_total', 4)} AS xg_total, age, {_r('market_value', 4)} AS market_value, contract_years_left, salary, injury_risk FROM candidates"),
    "involving_filter": _with(MATCHES, "SELECT DISTINCT match_id, home, away FROM happened WHERE home = 3 OR away = 3"),
    "team_events": _with(MATCHES, "SELECT match_id, line, entity, outcome FROM happened WHERE team = 3"),
    "shot_rows": _with(LOG, f"SELECT entity, event_type, {_r('coalesce(exposure, 0)', 4)} AS exposure, outcome FROM log WHERE is_shot"),
    "default_profile": """WITH counts AS (SELECT o_custkey, count(*) AS shots, count(*) FILTER (WHERE o_orderstatus = 'F') AS goals FROM orders GROUP BY o_custkey)
SELECT c_name AS player, 0.0::DOUBLE AS profit, 0.0::DOUBLE AS probability, 'balanced_player' AS style, 'average' AS efficiency, 0 AS minutes, coalesce(shots, 0) AS shots, 0.0::DOUBLE AS xg_total, coalesce(goals, 0) AS goals,
  0 AS assists, 0 AS dribbles, 0 AS key_passes, 0 AS progressive_passes, 0 AS pressures, 0 AS tackles, 0 AS interceptions FROM customer LEFT JOIN counts ON c_custkey = o_custkey""",
    "strategy_flags": _with(f"{PLAYERS}, {FLAGS}", "SELECT entity, is_rentable, is_offensif, is_efficace, is_low_risk, is_polyvalent FROM flags"),
    "strategy_filter": _with(PLAYERS, "SELECT entity, profit, probability FROM players WHERE profit > 0 AND probability > 0.6::DOUBLE"),
    "strategy_fallback": _with(PLAYERS, f"SELECT entity, profit, NOT (SELECT count(*) > 0 FROM players WHERE {_UNREACHABLE}) AS fallback FROM players WHERE ({_UNREACHABLE}) OR NOT (SELECT count(*) > 0 FROM players WHERE {_UNREACHABLE})"),
    "strategy_relax": _with(PLAYERS, f""", leveled AS (SELECT *, CASE WHEN {_UNREACHABLE} THEN 0 WHEN {_LOOSE} THEN 1 ELSE 2 END AS own FROM players)
SELECT entity, profit, (SELECT min(own) FROM leveled) AS level FROM leveled WHERE own <= (SELECT min(own) FROM leveled)"""),
    "roster_distinct": _with(MATCHES, "SELECT DISTINCT entity FROM happened WHERE season = 1997 AND team = 3"),
    "roster_stats": _with(MATCHES, f"""SELECT entity, {_r("x", 4)} AS xg_total, goals_total, shots, {_r("goals_total / shots::DOUBLE", 4)} AS conversion_rate FROM (
  SELECT entity, sum(exposure::DECIMAL(18,4))::DOUBLE * {_FACTOR} AS x, sum(outcome)::BIGINT AS goals_total, count(*) AS shots FROM happened
  WHERE season = 1997 AND entity IN (SELECT entity FROM happened WHERE season = 1997 AND team = 3) GROUP BY entity)"""),
    "needs_lookup": _with(SQUADS, "SELECT weakness, away, position_no, priority, position, profile, reason FROM gaps JOIN needs USING (weakness)"),
    "pair_compare": _with(PAIRS, "SELECT * FROM compared"),
    "scenario_cross": _with(SCORED, " UNION ALL ".join(f"SELECT player, '{n}' AS scenario, {s} AS score, {_LEVEL.format(s)} AS level, {r} AS reasons FROM scored" for n, (s, r) in _SCENARIOS.items())),
    "request_recommend": _with(ANSWERED, "SELECT conv_id, turn, strategies, entity, profit, fallback FROM answered"),
    "request_relax": _with(ANSWERED, f""", held AS (SELECT s.set, count(*) AS n FROM bits b, range(0, 32) s(set) WHERE (b.bits & s.set) = s.set GROUP BY s.set
), tried AS (SELECT conv_id, turn, strategies, level, s FROM (SELECT *, unnest([0, 1, 2]) AS level, unnest([wanted, wanted & 30, 0]) AS s FROM asked)
), found AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level) AS k FROM tried JOIN held ON s = held.set)
SELECT conv_id, turn, strategies, level, concat_ws('|', {", ".join(f"CASE WHEN (s & {1 << i}) > 0 THEN '{w}' END" for i, w in enumerate(_WORDS))}) AS strategies_left, n AS rows, best.entity, best.profit
FROM found JOIN best ON best.set = s WHERE k = 1"""),
    "shot_features": _with(LOG, f"SELECT {_FEATURES}, {_r('conversion_rate', 4)} AS conversion_rate, {_r('avg_xg_per_shot', 4)} AS avg_xg_per_shot FROM features"),
    "activity_counters": _with(PER90, "SELECT entity, minutes, assists, key_passes, progressive_passes, pressures, tackles, interceptions, dribbles FROM counted"),
    "rate_posterior": _with(PLAYERS, "SELECT entity, mean_rate, probability FROM posterior"),
    "rate_posterior_parts": _with(CANDIDATES, "SELECT player, probability FROM candidates"),
    "posterior_summary": _with(PLAYERS, _ends()),
    "expected_profit": _with(PLAYERS, "SELECT entity, profit FROM players"),
    "decide_sign": _with(PLAYERS, "SELECT entity, decision, probability, profit FROM players"),
    "squad_totals": _with(SQUADS, "SELECT * FROM report"),
    "squad_weaknesses": _with(SQUADS, "SELECT away, position_no, weakness FROM gaps"),
    "funnel_counts": _with(PLAYERS, "SELECT (SELECT count(DISTINCT match_id) FROM log WHERE is_shot) AS matches, count(*) AS analysed, count(*) FILTER (WHERE profit > 0) AS profitable, count(*) FILTER (WHERE profit > 0 AND probability > 0.6::DOUBLE) AS kept FROM players"),
    "rank_by_profit": _with(PLAYERS, "SELECT style, entity, profit, row_number() OVER (PARTITION BY style ORDER BY profit DESC, entity) AS rank FROM players"),
    "topk_reuse": _with(PLAYERS, "SELECT * FROM (SELECT style, row_number() OVER (PARTITION BY style ORDER BY profit DESC, entity) AS rank, row_number() OVER (ORDER BY profit DESC, entity) AS place, entity, profit FROM players) WHERE rank <= 3"),
    "recommend_top1": _with(PLAYERS, "SELECT style, entity, profit, CASE WHEN profit <= 0 THEN 'no_profitable_candidate' ELSE 'recommended' END AS message FROM (SELECT *, row_number() OVER (PARTITION BY style ORDER BY profit DESC, entity) AS n FROM players) WHERE n = 1"),
    "first_n": _with(PLAYERS, "SELECT entity, profit FROM players ORDER BY entity LIMIT 50"),
    "per90": _with(PER90, "SELECT * FROM per90"),
    "infer_style": _with(LOG, f"SELECT entity, {STYLE} AS style FROM features"),
    "infer_efficiency": _with(LOG, f"SELECT entity, {EFFICIENCY} AS efficiency, {EFFICIENCY.replace('conversion_rate', 'by_exposure')} AS efficiency_by_exposure FROM (SELECT *, CASE WHEN xg_total > 0 THEN goals_total::DOUBLE / xg_total ELSE 0 END AS by_exposure FROM features)"),
    "feature_scale": _with(LOG, f"SELECT entity, {_r('xg_total / 10', 4)} AS xg_total, shots / 10::DOUBLE AS shots, goals_total FROM features"),
    "build_profile": _with(LOG, f"SELECT {_FEATURES}, {STYLE} AS style, {EFFICIENCY} AS efficiency FROM features"),
    "archetypes": _archetype_sql(),
    "tactical_fit": _with(SCORED, "SELECT player, tactical_fit_score, tactical_fit_level, tactical_fit_reasons FROM scored"),
    "market_score": _with(SCORED, "SELECT player, market_score, market_level, market_reasons FROM scored"),
    "transfer_success": _with(SCORED, "SELECT player, transfer_score / 100::DOUBLE AS probability, transfer_level AS decision, transfer_risk AS risk, transfer_reasons FROM scored"),
    "detect_strategies": f"SELECT conv_id, turn, {_listed('|')} AS strategies FROM conversations WHERE role = 'user'",
    "reason_codes": f"SELECT conv_id, turn, {_reasons('|')} AS reasons FROM conversations WHERE role = 'user'",
    "explanation_text": _with(PLAYERS, "SELECT entity, 'entity ' || entity || ': expected profit ' || profit::DECIMAL(18,2) || ', chance ' || floor(probability * 100 + 0.5::DOUBLE)::BIGINT || '%, style ' || style AS explanation FROM players"),
    "comparison_text": _with(PAIRS, "SELECT a, b, 'profit: ' || more_profit || ', probability: ' || more_probable || ', styles: ' || style_a || ' / ' || style_b AS comparison FROM compared"),
    "response_text": _with(ANSWERED, f"SELECT conv_id, turn, {_RESPONSE} AS response FROM answered"),
    "posterior_superiority": _with(PAIRS, _SUPERIORITY),
    "group_superiority": f"""WITH counts AS (SELECT event_type AS g, value AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2), kinds AS (SELECT DISTINCT g FROM counts)
SELECT a, b, {_r("sum(won)::DOUBLE / (2.0::DOUBLE * sum(n_a) * max(all_b))", 6)} AS p_superior FROM (
  SELECT x.g AS a, y.g AS b, x.v, x.n AS n_a, sum(CASE WHEN z.v < x.v THEN 2 * z.n WHEN z.v = x.v THEN z.n ELSE 0 END) * x.n AS won, sum(z.n) AS all_b
  FROM kinds y JOIN counts x ON x.g < y.g JOIN counts z ON z.g = y.g GROUP BY x.g, y.g, x.v, x.n) GROUP BY a, b""",
    "tail_profile": f"""WITH base AS (SELECT event_type, value, sum(value::DECIMAL(18,4)) OVER (PARTITION BY event_type)::DOUBLE / count(*) OVER (PARTITION BY event_type) AS m FROM events WHERE value IS NOT NULL),
points AS (SELECT event_type, quantile_cont(value, 0.01) AS q1, quantile_cont(value, 0.05) AS q5, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99 FROM base GROUP BY event_type)
SELECT event_type, count(*) AS n, {_r("max(m)", 4)} AS mean, {_r("sqrt(sum((value - m) ** 2) / (count(*) - 1))", 4)} AS stddev, {_r("count(*) * sum((value - m) ** 4) / (sum((value - m) ** 2) * sum((value - m) ** 2)) - 3", 4)} AS excess_kurtosis,
  {_r("max(q1)", 4)} AS p01, {_r("max(q5)", 4)} AS p05, {_r("max(q95)", 4)} AS p95, {_r("max(q99)", 4)} AS p99, {_r("sum(CASE WHEN value <= q5 THEN value END::DECIMAL(18,4))::DOUBLE / count(CASE WHEN value <= q5 THEN 1 END)", 4)} AS tail_mean
FROM base JOIN points USING (event_type) GROUP BY event_type""",
    "candidate_board": _with(SCORED, "SELECT player, tactical_fit_score, tactical_fit_level, market_score, market_level, transfer_score, transfer_level, transfer_risk, " + ", ".join(f"{s} AS {n}_score, {_LEVEL.format(s)} AS {n}_level" for n, (s, _) in _SCENARIOS.items()) + " FROM scored"),
    "squad_board": _with(f"{SQUADS}, {_posterior('rated', 'members', 'entity')}", f""", extra AS (
  SELECT away, count(*) AS players, {_r("sum(probability::DECIMAL(18,4))::DOUBLE / count(*)", 4)} AS mean_probability, sum({_r("mean_rate * xg_total * 10 - 15")}::DECIMAL(18,2))::DOUBLE AS squad_profit,
    {", ".join(f"count(*) FILTER (WHERE style = '{x}') AS n_{x}" for x in ("high_volume_attacker", "low_volume_player", "balanced_player"))}, {", ".join(f"count(*) FILTER (WHERE efficiency = '{x}') AS n_{x}" for x in ("clinical_finisher", "underperforming", "average_finisher"))},
    count(*) FILTER (WHERE {_r("mean_rate * xg_total * 10 - 15")} > 0) AS n_recruit
  FROM (SELECT *, {STYLE} AS style, {EFFICIENCY} AS efficiency FROM (SELECT *, goals_total / shots::DOUBLE AS conversion_rate FROM members) JOIN rated USING (entity)) GROUP BY away
), listed AS (SELECT away, string_agg(weakness || ':' || priority || ':' || position, '|' ORDER BY position_no) AS needs FROM gaps JOIN needs USING (weakness) GROUP BY away)
SELECT r.*, extra.* EXCLUDE (away), coalesce(l.needs, '') AS needs FROM report r JOIN extra USING (away) LEFT JOIN listed l USING (away)"""),
    "request_board": _with(ANSWERED, f"SELECT conv_id, turn, strategies, a.entity, a.profit, fallback, style, efficiency, probability, decision, response FROM (SELECT *, {_RESPONSE} AS response FROM answered) a LEFT JOIN players p ON a.entity = p.entity"),
    **{f"scenario_{n}": _with(SCORED, f"SELECT player, {s} AS {n}_score, {_LEVEL.format(s)} AS {n}_level, {r} AS {n}_reasons FROM scored") for n, (s, r) in _SCENARIOS.items()},
}
#: The same over all entities: without the bound on the rank.
SQL |= {f"{n}_all": SQL[n].replace(" WHERE n <= 10) WHERE b", ") WHERE b") for n in ("pair_compare", "comparison_text", "posterior_superiority")}
