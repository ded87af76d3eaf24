"""Weak supervision of text quality, with DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0) on each document. A document is good
or bad, unseen; expectation-maximisation estimates how often bad documents there
are and how each rule votes on good and on bad ones, from the counts of the voting
patterns (at most 3 ** 8 rows). The posterior chance of good replaces a filter
that all rules must pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm import shared

_SPACES = " \t\n\x0b\x0c\r"
_BREAK = r"[\x20\x09-\x0D]+"
VOTES = ("length", "word_length", "symbols", "symbol_runs", "duplicate_lines", "repetition", "capitals", "exclamations")
#: Pseudo-counts of each vote in each class, and rounds of EM.
SMOOTHING, ROUNDS = 1.0, 15
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50


def _repeated_words(words: Column, count: Column) -> tuple[Column, Column, Column]:
    """In three steps, each on columns of the step before: windows, repeated windows in order, words in them."""
    windows = F.when(
        count >= 3,
        F.transform(F.slice(words, 1, F.greatest(count - 2, F.lit(0)).cast("int")), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    held = F.col("__windows")
    placed = F.when(F.size(F.array_distinct(held)) < F.size(held), F.sort_array(F.transform(held, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ranked = F.col("__placed")

    def twice(x, i):
        return (F.get(ranked, i - 1)["h"] == x["h"]) | F.coalesce(F.get(ranked, i + 1)["h"] == x["h"], F.lit(False))

    starts = F.transform(F.filter(ranked, lambda x, i: F.coalesce(twice(x, i), F.get(ranked, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2))))
    return windows, placed, F.coalesce(F.size(F.when(ranked.isNotNull(), covered)), F.lit(0)).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_symbol_runs, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_exclamations and base_failed.

    Words are runs of other characters than 0x20 and 0x09 to 0x0D. A null text has
    none. Columns of these names are replaced; no row is lost.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_symbol_runs", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations", "base_failed"]
    docs = docs.drop(*names)
    whole = F.coalesce(F.col(text), F.lit(""))
    solid, trimmed = F.translate(whole, _SPACES, ""), F.btrim(whole, F.lit(_SPACES))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    first = docs.withColumns({
        "__words": F.when(trimmed != "", F.split(trimmed, _BREAK)).otherwise(F.array().cast("array<string>")),
        "__lines": lines,
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long"),
        "n_symbol_runs": F.regexp_count(whole, F.lit(r"[#*$%&|<>]+")).cast("long"),
        "n_capitals": (F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "n_exclamations": (F.length(whole) - F.length(F.translate(whole, "!", ""))).cast("long"),
    })
    sized = first.withColumns({"n_words": F.size("__words").cast("long"), "n_lines": F.size("__lines").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")})
    windows, placed, covered = _repeated_words(F.col("__words"), F.col("n_words"))
    counted = sized.withColumn("__windows", windows).withColumn("__placed", placed).withColumn("n_repeat_words", covered)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).select(*docs.columns, *names)


def votes() -> dict[str, Column]:
    """A vote column for each rule, from the columns of :func:`measured`."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "length": vote(words < LEAST_WORDS, words >= 2 * LEAST_WORDS),
        "word_length": vote((chars > 12 * words) | (chars < 2.5 * words), (chars <= 9 * words) & (chars >= 3 * words)),
        "symbols": vote(100 * F.col("n_symbols") > 3 * chars, F.col("n_symbols") * 1000 <= chars),
        "symbol_runs": vote(10 * F.col("n_symbol_runs") > words, 100 * F.col("n_symbol_runs") <= words),
        "duplicate_lines": vote((F.col("n_dup_lines") >= 3) & (4 * F.col("n_dup_lines") > F.col("n_lines")), F.col("n_dup_lines") == 0),
        "repetition": vote(100 * F.col("n_repeat_words") > 30 * words, 100 * F.col("n_repeat_words") <= 5 * words),
        "capitals": vote(2 * F.col("n_capitals") > chars, 5 * F.col("n_capitals") <= chars),
        "exclamations": vote(10 * F.col("n_exclamations") > words, 100 * F.col("n_exclamations") <= words),
    }


def _log_odds(model: dict) -> Column:
    """Log odds of good, given the vote columns."""
    total = F.lit(math.log(model["good"]) - math.log(1 - model["good"]))
    for name in VOTES:
        steps = [math.log(g) - math.log(b) for g, b in zip(model[name][1], model[name][0], strict=True)]
        total = total + F.when(F.col(f"vote_{name}") == -1, steps[0]).when(F.col(f"vote_{name}") == 0, steps[1]).otherwise(steps[2])
    return total


def learned(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """EM over (vote_*, n): the share of good, and for each rule its chances of -1, 0, 1 on bad and on good documents.

    It starts from the votes: each bad vote leaves a document a quarter of its chance of good.
    """
    bad_votes = sum((F.when(F.col(f"vote_{v}") == -1, 1).otherwise(0) for v in VOTES), F.lit(0))
    posterior = F.lit(0.95) * F.pow(F.lit(0.25), bad_votes)
    by_vote = [(v, said) for v in VOTES for said in (-1, 0, 1)]

    def sums(weight: Column) -> list[float]:
        row = patterns.agg(F.sum(weight), *(F.sum(F.when(F.col(f"vote_{v}") == said, weight).otherwise(0.0)) for v, said in by_vote)).first()
        return [x or 0.0 for x in row]

    everything, model = sums(F.col("n").cast("double")), {}
    for _ in range(rounds):
        goods = sums(posterior * F.col("n"))
        good, bad = goods[0] + SMOOTHING, everything[0] - goods[0] + SMOOTHING
        model = {"good": good / (good + bad)}
        for k, v in enumerate(VOTES):
            span = slice(1 + 3 * k, 4 + 3 * k)
            counts = [[a - g + SMOOTHING for a, g in zip(everything[span], goods[span], strict=True)], [g + SMOOTHING for g in goods[span]]]
            model[v] = [[c / sum(kind) for c in kind] for kind in counts]
        posterior = 1 / (1 + F.exp(-_log_odds(model)))
    return model


def accuracies(model: dict) -> dict[str, tuple[float, float]]:
    """Of each rule, how often its vote is right on bad and on good documents, where it votes."""
    return {v: (bad[0] / (bad[0] + bad[2]), good[2] / (good[0] + good[2])) for v in VOTES for bad, good in [model[v]]}


def judged(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs``, without ``text``, with the measures, the votes, quality (posterior chance of good) and kept.

    kept is false where base_failed, else whether quality is ``least`` or more. The
    model is learned from all documents, repeated rows included. One row for each
    input row; columns of the names added are replaced. An empty table stays empty.
    """
    rows = measured(docs.drop("quality", "kept"), text).drop(text)
    rows = shared.written(rows.withColumns({f"vote_{n}": c for n, c in votes().items()}), "votes")
    patterns = shared.written(rows.groupBy(*(f"vote_{v}" for v in VOTES)).agg(F.count(F.lit(1)).alias("n")), "patterns")
    model = learned(patterns)
    quality = 1 / (1 + F.exp(-_log_odds(model)))
    return rows.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
