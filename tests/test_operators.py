"""Golden rows, boundaries, nulls and properties of the operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreframe.functions.numbers import exact_sum, rounded
from scoreframe.operators import distributions, events, ranking, rates, rules, squad, strategies
from scoreframe.plans import catalog, scorecards
from scoreframe.sources import tables

CANDIDATES = [
    dict(player="A", position="LW", style="offensive_player", efficiency="elite_finisher", probability=0.81, shots=42, xg_total=8.4, age=25, market_value=90, contract_years_left=3, salary=14, injury_risk="medium"),
    dict(player="B", position="CM", style="balanced_player", efficiency="elite_controller", probability=0.88, shots=12, xg_total=2.1, age=29, market_value=50, contract_years_left=1, salary=16, injury_risk="low"),
    dict(player="C", position="ST", style="offensive_player", efficiency="clinical_finisher", probability=0.79, shots=51, xg_total=10.7, age=24, market_value=75, contract_years_left=4, salary=12, injury_risk="medium"),
]


def test_golden_candidates(spark):
    rows = tables.candidates_from_rows(spark, CANDIDATES)
    for card in (scorecards.TACTICAL_FIT, scorecards.MARKET, scorecards.TRANSFER, *map(scorecards.scenario, scorecards.SCENARIOS)):
        rows = rules.scored(rows, card)
    got = {r["player"]: r for r in rows.collect()}
    want = {
        "tactical_fit": [(15, "ELITE"), (9, "HIGH"), (12, "ELITE")], "market": [(4, "RISKY"), (9, "GOOD"), (8, "GOOD")], "transfer": [(75, "MONITOR"), (85, "SIGN"), (95, "SIGN")],
        "economic": [(0, "LOW_PRIORITY"), (2, "LOW_PRIORITY"), (3, "LOW_PRIORITY")], "win_now": [(4, "LOW_PRIORITY"), (6, "INTERESTING"), (8, "PRIORITY")],
        "young_talent": [(3, "LOW_PRIORITY"), (2, "LOW_PRIORITY"), (3, "LOW_PRIORITY")], "injury_crisis": [(3, "LOW_PRIORITY"), (8, "PRIORITY"), (3, "LOW_PRIORITY")],
        "star_departure": [(9, "PRIORITY"), (2, "LOW_PRIORITY"), (9, "PRIORITY")],
    }
    for name, each in want.items():
        assert [(got[p][f"{name}_score"], got[p][f"{name}_level"]) for p in "ABC"] == each, name


def test_transfer_combinations(spark):
    fits, markets, ages, risks, salaries = ("ELITE", "HIGH", "MEDIUM", "LOW"), ("EXCELLENT", "GOOD", "RISKY", "VERY GOOD"), (20, 25, 33), ("low", "medium", "high"), (10, 18)
    combos = list(itertools.product(fits, markets, ages, risks, salaries))
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(combos)], "i int, tactical_fit_level string, market_level string, age int, injury_risk string, salary int")
    got = {r["i"]: r["transfer_score"] for r in rules.scored(rows, scorecards.TRANSFER).collect()}
    points = ({"ELITE": 25, "HIGH": 15, "MEDIUM": 5}, {"EXCELLENT": 20, "GOOD": 10, "RISKY": -10}, {25: 10, 33: -15}, {"low": 10, "high": -20}, {18: -10})
    for i, combo in enumerate(combos):
        assert got[i] == max(1, min(99, 50 + sum(p.get(v, 0) for p, v in zip(points, combo, strict=True))))


def test_defaults_unknowns_and_missing_columns(spark):
    row = spark.createDataFrame([(19, None, "strange")], "age int, market_value int, injury_risk string")
    r = rules.scored(row, scorecards.MARKET).first()
    assert r["market_score"] == 0 + 2 + 0 + 1 - 3 and r["market_reasons"] == ["value_fair", "salary_fair", "injury_high"]
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        rules.scored(row, scorecards.TACTICAL_FIT).schema
    assert rules.scored(row, scorecards.scenario("nonsense")).first()["nonsense_score"] == 0


def test_posterior_golden_and_edges(spark):
    rows = spark.createDataFrame([("shots", 4.0, 4), ("none", 0.0, 0), ("odd", 0.0, 2), ("more", 4.0, 6), ("wide", 6.0, 4)], "k string, xg_total double, goals_total long")
    got = {r["k"]: r for r in rates.rate_posterior(rows, "k", digits=7).collect()}
    assert got["shots"]["mean_rate"] == pytest.approx(1.0308575, abs=2e-6) and got["shots"]["probability"] == pytest.approx(0.4766840, abs=2e-6)
    assert got["none"]["probability"] == 0.5 and "odd" not in got
    assert got["more"]["mean_rate"] > got["shots"]["mean_rate"] > got["wide"]["mean_rate"]
    assert all(0 <= r["probability"] <= 1 and r["edge_mass"] < 1e-9 for r in got.values())
    assert [tuple(r) for r in rates.quality(rows, "k").collect()] == [("odd", "outcome_without_exposure")]
    pairs = spark.createDataFrame([("shots", "shots"), ("more", "wide")], "a string, b string")
    p = {(r["a"], r["b"]): r["p_superior"] for r in rates.superiority(pairs, rows, "k").collect()}
    assert p["shots", "shots"] == 0.5 and p["more", "wide"] > 0.5


def test_posterior_is_one_shuffle_without_python(spark):
    log = spark.createDataFrame([(1, 0.5, 1), (1, 0.2, 0), (2, 0.1, 0)], "k int, exposure double, outcome int")
    features = events.shot_features(log, "k")
    plan = rates.rate_posterior(features, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_squad_golden(spark):
    players = spark.createDataFrame([(42, 8.4, 6), (12, 2.1, 1), (51, 10.7, 9)], "shots int, xg_total double, goals_total int")
    report = squad.totals(players)
    r = report.first()
    assert (r["team_xg"], r["team_goals"], r["team_shots"], r["conversion_rate"], r["offensive_players"]) == (21.2, 16, 105, 0.15, 3)
    assert [x["weakness"] for x in squad.weaknesses(report).orderBy("position_no").collect()] == ["low_efficiency", "few_offensive_profiles"]
    assert {x["position"] for x in squad.needs(squad.weaknesses(report)).collect()} == {"ST", "AM/LW"}
    assert squad.totals(players.limit(0)).first()["conversion_rate"] == 0


def test_event_edges(spark):
    log = spark.createDataFrame([("a", 1, True, None, 1), ("a", 1, True, float("nan"), None), ("b", 2, False, 1.0, 0)], "entity string, match_id int, is_shot boolean, exposure double, outcome int")
    r = events.shot_features(events.shot_rows(log), "entity").collect()
    assert [(x["entity"], x["xg_total"], x["goals_total"], x["shots"]) for x in r] == [("a", 0.0, 1, 2)]
    doubled = spark.createDataFrame([(1,), (1,)], "match_id int")
    assert events.in_matches(log, doubled).count() == 2
    profile = events.with_defaults(spark.createDataFrame([(None, 3)], "player string, shots int"), events.PROFILE_DEFAULTS).first()
    assert profile["player"] == "Unknown" and profile["shots"] == 3 and profile["tackles"] == 0


def test_per90_and_archetypes(spark):
    columns = ", ".join(f"{m} long" for m in events.METRICS)
    rows = spark.createDataFrame([(90, *[3] * 10), (0, *[3] * 10), (None, *[3] * 10)], f"minutes long, {columns}")
    got = events.archetypes(events.per90(rows)).collect()
    assert got[0]["primary"] == "box_poacher" and got[0]["secondary"] == ["ball_winning_6", "transition_monster", "inverted_creator"]
    assert [r["primary"] for r in got[1:]] == ["balanced_player"] * 2 and got[1]["secondary"] == []


def test_strategies(spark):
    rows = spark.createDataFrame([(1, 5.0, 6, "average_finisher", 0.7, "balanced_player"), (2, -1.0, 2, None, None, "low_volume_player")], "entity int, profit double, shots int, efficiency string, probability double, style string")
    asked = strategies.detected(spark.createDataFrame([(1, "xx THING yy"), (2, "nothing"), (3, None), (4, "erble")], "i int, text string"), {"rentable": "thing", "offensif": "q1", "efficace": "erble", "low_risk": "q2", "polyvalent": "q3"})
    got = {r["i"]: r for r in strategies.recommended(asked, rows, "entity").collect()}
    assert got[1]["strategies"] == ["rentable"] and [got[i]["entity"] for i in (1, 2, 3, 4)] == [1, 1, 1, 1]
    assert [got[i]["fallback"] for i in (1, 2, 3, 4)] == [False, False, False, True]
    assert strategies.relaxed(rows, ["efficace", "rentable"]).first()["level"] == 2
    assert strategies.with_fallback(rows, ["efficace"]).count() == 2 and strategies.filtered(rows, []).count() == 2


def test_pairs_and_ties(spark):
    rows = spark.createDataFrame([("x", 1.0, 0.5, "s"), ("y", 1.0, 0.4, "t")], "k string, profit double, probability double, style string")
    r = ranking.compared(spark.createDataFrame([("x", "y")], "a string, b string"), rows, "k").first()
    assert (r["more_profit"], r["more_probable"]) == ("y", "x")
    assert ranking.top(rows, "k").first()["k"] == "x"


def test_distributions(spark):
    rows = spark.createDataFrame([("p", 1.0), ("p", 2.0), ("q", 2.0), ("q", 3.0), ("q", None)], "g string, v double")
    pairs = spark.createDataFrame([("p", "q"), ("q", "p")], "a string, b string")
    got = {r["a"]: r["p_superior"] for r in distributions.group_superiority(rows, pairs, "g", "v").collect()}
    assert got == {"p": 0.125, "q": 0.875}
    assert {r["g"]: r["n"] for r in distributions.tail_profile(rows, "g", "v").collect()} == {"p": 2, "q": 2}


def test_written_results_and_tolerant_reads(spark, tmp_path):
    rows = spark.createDataFrame([(1, "economic"), (2, "win_now")], "player int, scenario string")
    tables.write_results(rows, f"{tmp_path}/t.parquet", "scenario")
    (tmp_path / "t.parquet" / "scenario=economic" / "bad.parquet").write_bytes(b"not parquet")
    assert sorted(r["player"] for r in tables.table(spark, str(tmp_path), "t", tolerant=True).select("player").collect()) == [1, 2]
    stacked = tables.stacked(rows, rows.withColumn("more", F.lit(1)))
    assert stacked.count() == 4 and stacked.where("more IS NULL").count() == 2


def test_posterior_of_large_sums(spark):
    cases = [(s, g) for n in (1e3, 1e4, 1e6, 1e8) for s, g in ((n, n), (n, n + 0.7 * n**0.5), (n / 3, n))] + [(1e6, 0), (1e-3, 50), (4.0, 4)]
    rows = spark.createDataFrame([(i, float(s), float(g)) for i, (s, g) in enumerate(cases)], "k int, xg_total double, goals_total double")

    def fine(s, g):
        """Log rates around the mode, the chance of each cell, and the posterior's standard deviation there."""
        low, high = -50.0, 50.0
        for _ in range(200):
            m = (low + high) / 2
            low, high = (m, high) if s * np.exp(m) + 4 * m < g else (low, m)
        sd = 1 / np.sqrt(s * np.exp(m) + 4)
        d = (np.arange(400_000) + 0.5) / 400_000 * 24 * sd - 12 * sd
        p = np.exp(g * d - s * np.exp(m) * np.expm1(d) - 2 * d * (d + 2 * m))
        return m + d, p / p.sum(), sd

    found = {r["k"]: r for r in rates.rate_posterior(rows, "k", digits=9).collect()}
    ends = {r["k"]: r for r in rates.posterior_summary(rows, "k").collect()}
    for k, (s, g) in enumerate(cases):
        (t, p, sd), r = fine(s, g), found[k]
        mean = (p * np.exp(t)).sum()
        assert r["mean_rate"] == pytest.approx(mean, rel=1e-7, abs=1e-9) and r["probability"] == pytest.approx(p[t > 0].sum(), abs=1e-5), (s, g)
        assert r["sd_rate"] == pytest.approx(np.sqrt((p * (np.exp(t) - mean) ** 2).sum()), rel=1e-3, abs=2e-9) and r["edge_mass"] < 1e-9 and r["sd_steps"] >= 1
        if k < len(cases) - 1:
            for name, share in (("low", 0.03), ("high", 0.97)):
                want = np.exp(np.interp(share, p.cumsum(), t))
                assert ends[k][name] == pytest.approx(want, abs=5.1e-5 + 2e-3 * sd * want), (s, g)
    pairs = [(a, b) for a in range(len(cases)) for b in range(len(cases)) if a != b]
    got = {(r["a"], r["b"]): r["p_superior"] for r in rates.superiority(spark.createDataFrame(pairs, "a int, b int"), rows, "k").collect()}
    assert len(got) == len(pairs)
    each = [fine(s, g) for s, g in cases]
    for a, b in pairs:
        (t, p, _), (u, q, _) = each[a], each[b]
        assert got[a, b] == pytest.approx((p * np.interp(t, u, q.cumsum() - q / 2, 0, 1)).sum(), abs=2e-4), (cases[a], cases[b])


def test_neighbour_pairs_of_all_rows(spark):
    rows = spark.range(500).selectExpr("id AS k", "CAST(id * 7919 % 61 AS double) AS profit")
    ranked = sorted(((r["k"], r["profit"]) for r in rows.collect()), key=lambda r: (-r[1], r[0]))
    want = sorted((a[0], b[0]) for a, b in zip(ranked[:-1], ranked[1:], strict=True))
    assert sorted(map(tuple, ranking.neighbour_pairs(rows, "k").collect())) == want
    assert sorted(map(tuple, ranking.neighbour_pairs(rows.repartition(7), "k", n=10).collect())) == sorted((a[0], b[0]) for a, b in zip(ranked[:9], ranked[1:10], strict=True))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many ranges as partitions
    try:
        for few in (rows, rows.limit(3), rows.limit(1)):
            assert len(ranking.neighbour_pairs(few, "k").collect()) == few.count() - 1
        assert sorted(map(tuple, ranking.neighbour_pairs(rows, "k").collect())) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_requests_with_string_keys(spark):
    rows = spark.createDataFrame([("ann", 5.0, 6, "x", 0.7, "s"), ("bea", 5.0, 6, "x", 0.7, "s"), ("cid", None, 9, "x", 0.9, "s")], "player string, profit double, shots int, efficiency string, probability double, style string")
    asked = spark.createDataFrame([(1, ["offensif"]), (2, ["efficace"])], "i int, strategies array<string>")
    got = {r["i"]: r for r in strategies.recommended(asked, rows, "player").collect()}
    assert [(got[i]["player"], got[i]["profit"], got[i]["fallback"]) for i in (1, 2)] == [("ann", 5.0, False), ("ann", 5.0, True)]


def test_sums_keep_small_digits(spark):
    rows = spark.range(1000).selectExpr("'e' AS entity", "0.12345678D AS exposure", "0 AS outcome")
    assert rows.agg(exact_sum(F.col("exposure")).alias("s")).first()["s"] == pytest.approx(123.45678, abs=1e-9)


def test_group_superiority_of_any_kinds(spark, tmp_path):
    rows = [(k, float(v)) for k, at in (("a new kind", 0), ("view", 1), ("zoom", 2)) for v in range(at, at + 4)]
    spark.createDataFrame(rows, "event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["a"], r["b"]): r["p_superior"] for r in catalog.QUERIES["group_superiority"](spark, str(tmp_path)).collect()}
    assert set(got) == {("a new kind", "view"), ("a new kind", "zoom"), ("view", "zoom")} and got["view", "zoom"] == pytest.approx(4.5 / 16)


def test_ranked_rows_written_once_answer_every_top_k(spark, tmp_path):
    """A ranked table is stored and read again for any k, without being ranked anew."""
    rows = spark.range(50).selectExpr("id AS player", "double(pmod(id * 7, 13)) AS profit", "concat('g', id % 3) AS style")
    ranking.ranked(rows, "player", "style").write.partitionBy("style").parquet(f"{tmp_path}/ranked")
    stored = spark.read.parquet(f"{tmp_path}/ranked")
    for k in (1, 4):
        want = {tuple(r) for r in ranking.top(rows, "player", group="style", n=k).select("player", "profit", "style", "rank").collect()}
        again = stored.where(F.col("rank") <= k)
        assert {tuple(r) for r in again.select("player", "profit", "style", "rank").collect()} == want
        assert "Window" not in again._jdf.queryExecution().toString()


def _uneven(spark, n=3000):
    """Groups of very different sizes, one of equal values, one of a single row, values that recur, nulls and NaN."""
    rng = random.Random(5)
    rows = [(rng.choice("aaaaaab"), float(rng.choice([0, 0, 1, rng.randrange(40), round(rng.gauss(0, 9), 6)])), i) for i in range(n)]
    rows += [("c", 2.5, n + i) for i in range(9)] + [("d", 7.0, -1), ("a", None, -2), (None, 1.0, -3), ("e", None, -4)]
    return spark.createDataFrame(rows, "g string, v double, k int").repartition(7), rows


def test_ranges_equal_brute_force(spark):
    frame, rows = _uneven(spark)
    values = {g: [r[1] for r in rows if r[0] == g and r[1] is not None] for g in "abcde"}
    got = {r["g"]: r for r in distributions.tail_profile(frame, "g", "v").collect()}
    assert set(got) == set("abcd")
    for g, r in got.items():
        v = np.array(values[g])
        d, low = v - v.mean(), np.quantile(v, 0.05)
        want = {"n": len(v), "mean": v.mean(), "p01": np.quantile(v, 0.01), "p05": low, "p95": np.quantile(v, 0.95), "p99": np.quantile(v, 0.99), "tail_mean": v[v <= low].mean()}
        want["stddev"] = v.std(ddof=1) if len(v) > 1 else None
        want["excess_kurtosis"] = len(v) * (d**4).sum() / (d**2).sum() ** 2 - 3 if d.any() else None
        assert {c: r[c] for c in want} == {c: w if w is None else pytest.approx(w, abs=1e-4) for c, w in want.items()}
    pairs = [(x, y) for x in "abcde" for y in "abcde" if x < y]
    found = {(r["a"], r["b"]): r["p_superior"] for r in distributions.group_superiority(frame, spark.createDataFrame(pairs, "a string, b string"), "g", "v").collect()}
    assert set(found) == {p for p in pairs if "e" not in p}
    for (x, y), p in found.items():
        d = np.subtract.outer(values[x], values[y])
        assert p == pytest.approx((d > 0).mean() + (d == 0).mean() / 2, abs=1e-6)
    none = frame.where("k > 100000")
    assert not distributions.tail_profile(none, "g", "v").count() and not distributions.group_superiority(none, spark.createDataFrame(pairs, "a string, b string"), "g", "v").count()


def test_ranks_equal_brute_force(spark):
    """Ranks over ranges of the order are those of one sorted list, with ties, nulls and a group of most rows."""
    frame, rows = _uneven(spark)
    want = {}
    for g in {r[0] for r in rows}:
        of = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {r[2]: i + 1 for i, r in enumerate(of)}
    ranked = ranking.ranked(frame, "k", "g", "v")
    assert ranked.columns == ["g", "v", "k", "rank"] and {r["k"]: r["rank"] for r in ranked.collect()} == want
    assert not ranking.ranked(frame.where("k > 100000"), "k", "g", "v").count()


def _fine(s, g):
    """Mode, offsets from it, the chance of each small cell, and the width of a cell."""
    low, high = -60.0, 60.0
    for _ in range(200):
        m = (low + high) / 2
        low, high = (m, high) if s * np.exp(m) + 4 * m < g else (low, m)
    sd = 1 / np.sqrt(s * np.exp(m) + 4)
    d = (np.arange(400_000) + 0.5) / 400_000 * 24 * sd - 12 * sd
    p = np.exp(g * d - s * np.exp(m) * np.expm1(d) - 2 * d * (d + 2 * m))
    return m, d, p / p.sum(), d[1] - d[0]


def test_posterior_of_all_sums(spark):
    """Sums from none to 1e10, and those next to the size at which an earlier rule changed."""
    sums = [0, 1e-6, 0.01, 0.5, 1, 3, 10, 50, 575, 590, 600, 612, 650, 1e4, 1e6, 1e8, 1e10]
    cases = [(s, g) for s in sums for g in sums if s or not g]
    rows = spark.createDataFrame([(i, float(s), float(g)) for i, (s, g) in enumerate(cases)], "k int, xg_total double, goals_total double")
    found = {r["k"]: r for r in rates.rate_posterior(rows, "k", digits=12).collect()}
    ends = {r["k"]: r for r in rates.posterior_summary(rows, "k").collect()}
    assert len(found) == len(ends) == len(cases)
    for k, (s, g) in enumerate(cases):
        (m, d, p, h), r, e = _fine(s, g), found[k], ends[k]
        below = np.cumsum(p)
        ratio = np.exp(m) * (1 + (p * np.expm1(d)).sum())
        assert r["probability"] == pytest.approx(1 - np.interp(-m, d + h / 2, below, 0, 1), abs=1e-7), (s, g)
        assert r["mean_rate"] == pytest.approx(ratio, rel=1e-7, abs=1e-11) and r["edge_mass"] < 1e-9 and r["sd_steps"] >= 1
        inner = np.argsort(-p)[: np.searchsorted(np.cumsum(np.sort(p)[::-1]), 0.94) + 1]
        want = {"low": np.interp(0.03, below, d + h / 2), "high": np.interp(0.97, below, d + h / 2), "densest_low": d[inner.min()], "densest_high": d[inner.max()]}
        for name, at in want.items():
            assert e[name] == pytest.approx(np.exp(m + at), rel=2 * h + 1e-5, abs=1e-4), (s, g, name)
    odd = spark.createDataFrame([("a", None, 1.0), ("b", -1.0, 1.0), ("c", float("inf"), 1.0), ("d", 1.0, float("nan")), ("e", 0.0, 1.0), (None, 1.0, 1.0)], "k string, xg_total double, goals_total double")
    assert {r["k"] for r in rates.rate_posterior(odd, "k").collect()} == {None} == {r["k"] for r in rates.posterior_summary(odd, "k").collect()}
    assert {r["k"]: r["reason"] for r in rates.quality(odd, "k").collect()} == {"a": "missing_sum", "b": "negative_sum", "c": "infinite_sum", "d": "infinite_sum", "e": "outcome_without_exposure"}


def test_posterior_keeps_the_columns_without_a_join(spark):
    log = spark.createDataFrame([(1, 0.5, 1, "x"), (1, 0.2, 0, "x"), (2, 0.1, 0, None)], "k int, exposure double, outcome int, name string")
    features = events.shot_features(log, "k", "name")
    rated = rates.rated(features, "k")
    said = rated._jdf.queryExecution().executedPlan().toString()
    assert said.count("Exchange") == 1 and "Join" not in said and "Window" not in said
    assert rated.columns[: len(features.columns)] == features.columns and {r["name"] for r in rated.collect()} == {"x", None}


def test_rounding_and_sums_of_any_values(spark):
    values = [1.005, 0.185, -2.5, 9.3e16, 1e300, float("inf"), float("-inf"), float("nan"), None, 1e-12, 2.0**53]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["r"] for r in rows.select("i", rounded(F.col("v"), 4).alias("r")).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10)] == [1.005, 0.185, -2.5, 9.3e16, 1e300, float("inf"), float("-inf"), None, 0.0, 2.0**53] and got[7] != got[7]

    def total(*v):
        return spark.createDataFrame([(x,) for x in v], "v double").agg(exact_sum(F.col("v")).alias("s")).first()["s"]

    assert total(0.1, 0.2, None) == pytest.approx(0.3, abs=1e-16) and total(None) == 0.0
    assert total(1e20, 0.5) == 1e20 and total(1e300, 1.0, -1e300) == 1.0 and total(1.0, float("inf")) == float("inf")
    assert total(1.0, float("nan")) != total(1.0, float("nan"))


def test_tail_profile_of_large_small_and_infinite_values(spark):
    inf = float("inf")
    groups = {"big": [1e20, 2e20, 4e20, 5e20], "huge": [-1e308, 1e308, 0.0], "tiny": [1e-12 * k for k in (1, 2, 4, 9)], "inf": [1.0, 2.0, 3.0, inf], "both": [-inf, 1.0, inf], "one": [inf], "nan": [float("nan"), 2.0]}
    rows = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x], "g string, v double")
    got = {r["g"]: r for r in distributions.tail_profile(rows, "g", "v").collect()}
    assert got["big"]["mean"] == pytest.approx(3e20) and got["big"]["stddev"] == pytest.approx(np.std(groups["big"], ddof=1)) and got["big"]["tail_mean"] == 1e20
    x = np.array(groups["big"]) / 1e20
    assert got["big"]["excess_kurtosis"] == pytest.approx(len(x) * ((x - x.mean()) ** 4).sum() / ((x - x.mean()) ** 2).sum() ** 2 - 3, abs=1e-4)
    assert got["huge"]["mean"] == 0 and got["huge"]["stddev"] == pytest.approx(1e308) and got["huge"]["p05"] == pytest.approx(-9e307)
    y = np.array([1, 2, 4, 9.0])
    assert got["tiny"]["excess_kurtosis"] == pytest.approx(4 * ((y - y.mean()) ** 4).sum() / ((y - y.mean()) ** 2).sum() ** 2 - 3, abs=1e-4)
    assert (got["inf"]["n"], got["inf"]["mean"], got["inf"]["stddev"], got["inf"]["excess_kurtosis"], got["inf"]["tail_mean"], got["inf"]["p95"]) == (4, inf, None, None, 1.0, inf)
    assert got["both"]["n"] == 3 and got["both"]["mean"] != got["both"]["mean"] and got["both"]["stddev"] is None and got["both"]["tail_mean"] == -inf
    assert got["one"]["mean"] == inf and got["one"]["p01"] == inf and (got["nan"]["n"], got["nan"]["mean"]) == (1, 2.0)


def test_lattice_equals_all_sets(spark):
    """Each of the 32 sets against a filter of all rows; the plan repeats no row."""
    rng = random.Random(11)
    made = [(i, rng.choice([None, -3.0, 0.0, 2.5, 2.5, 7.0]), rng.randrange(9), rng.choice(["clinical_finisher", "x", None]), rng.choice([None, 0.5, 0.9]), rng.choice(["balanced_player", "y"])) for i in range(60)]
    rows = spark.createDataFrame(made, "entity int, profit double, shots int, efficiency string, probability double, style string")
    names = list(strategies.STRATEGIES)
    passed = [lambda r: (r[1] or 0) > 0, lambda r: r[2] >= 5, lambda r: r[3] == "clinical_finisher", lambda r: (r[4] or 0) > 0.6, lambda r: r[5] == "balanced_player"]
    best = {}
    for mask in range(32):
        of = [r for r in made if all(f(r) for i, f in enumerate(passed) if mask >> i & 1)]
        if of:
            best[mask] = (len(of), min(of, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])))
    found = strategies.lattice(rows, "entity", keep=("style",))
    assert {r["set"]: (r["n"], r["best"]["entity"], r["best"]["style"]) for r in found.collect()} == {m: (n, r[0], r[5]) for m, (n, r) in best.items()}
    logical = found._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("Generate") == 1 and logical.index("Generate") < logical.rindex("Aggregate")
    asked = spark.createDataFrame([(m, [names[i] for i in range(5) if m >> i & 1]) for m in range(32)], "i int, strategies array<string>")
    answers = {r["i"]: r for r in strategies.recommended(asked, rows, "entity", keep=("style",)).collect()}
    relaxed = {r["i"]: r for r in strategies.relaxed_requests(asked, rows, "entity", dropped=("rentable", "low_risk")).collect()}
    for m in range(32):
        n, r = best.get(m, best[0])
        assert (answers[m]["entity"], answers[m]["profit"], answers[m]["fallback"], answers[m]["style"]) == (r[0], r[1], m not in best, r[5])
        level, left = next((k, s) for k, s in enumerate((m, m & ~1, m & ~9, 0)) if s in best)
        assert (relaxed[m]["level"], relaxed[m]["n"], relaxed[m]["entity"]) == (level, best[left][0], best[left][1][0]) and relaxed[m]["strategies_left"] == [names[i] for i in range(5) if left >> i & 1]
    none = {tuple(r)[2:] for r in strategies.relaxed_requests(asked, rows.limit(0), "entity").collect()}
    assert none == {(None,) * 5}
    assert {(r["entity"], r["fallback"]) for r in strategies.recommended(asked, rows.limit(0), "entity").collect()} == {(None, True)}


def test_places_and_neighbours_equal_brute_force(spark):
    frame, rows = _uneven(spark)
    frame = frame.where("v IS NOT NULL AND g IS NOT NULL")
    rows = sorted((r for r in rows if r[1] is not None and r[0] is not None), key=lambda r: (-r[1], r[2]))
    placed = ranking.placed(frame, "k", "g", "v")
    got = {r["k"]: (r["place"], r["rank"]) for r in placed.collect()}
    seen = {}
    for place, (g, _, k) in enumerate(rows, 1):
        seen[g] = seen.get(g, 0) + 1
        assert got[k] == (place, seen[g])
    pairs = {(r["a"], r["b"], r["v_a"], r["v_b"]) for r in ranking.neighbours(placed, "k", ["v"]).collect()}
    assert pairs == {(x[2], y[2], x[1], y[1]) for x, y in zip(rows, rows[1:], strict=False)}
    assert ranking.neighbours(placed, "k", [], n=10).count() == 9 and ranking.neighbours(placed.limit(0), "k", []).count() == 0
