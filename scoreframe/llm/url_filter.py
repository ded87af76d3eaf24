"""URL verdicts from rules, and from character language models where no rule fits; DataFrame functions only.

Two variable-order Markov models over characters are learned from the URLs that
rules accept and reject. A character's chance after the three characters before
it is smoothed by the chance after two, one and none (Witten-Bell: each shorter
context weighs as much as the longer one has had different successors). A URL's
score is the mean over its characters of the difference of the two
log-likelihoods; the cut between accepted and rejected is calibrated on a fifth of
the ruled URLs that the models don't see.

Characters come from 32 classes, so a model has at most 32**4 entries, whatever
the number of URLs: that bound allows its broadcast.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.llm import shared

#: Fixed values of the contract: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Characters in a context at most, and the classes: a letter is its own, a digit is 0, ^ is before the start, * is any other.
ORDER = 3
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-^*"
CALIBRATION_PARTS = 5
#: Scores are calibrated in steps of 1 / STEPS between -LIMIT and LIMIT.
STEPS, LIMIT = 200, 10


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path; both are empty without a ``://``. Columns of these names are replaced."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns({"host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    rule = verdict = None
    for said, of, under in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(under)
        rule = F.when(fits, of + under) if rule is None else rule.when(fits, of + under)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def _grams(text: Column) -> Column:
    """Each character's class behind those of the ORDER characters before it."""
    classes = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"[^a-z0./-]", "*")
    return F.regexp_extract_all(F.concat(F.lit("^" * ORDER), classes), F.lit(f"(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def _model(counts: DataFrame) -> list[DataFrame]:
    """From (accepted, gram, n): for contexts of 0 .. ORDER characters, a row (gram, ratio) for each seen context and each class."""
    each = F.explode(F.array(*map(F.lit, SYMBOLS))).alias("c")
    kinds = F.explode(F.array(F.lit(True), F.lit(False))).alias("accepted")
    shorter, out = None, []
    for k in range(ORDER + 1):
        seen = counts.groupBy("accepted", F.substring("gram", ORDER + 1 - k, k).alias("context"), F.substring("gram", ORDER + 1, 1).alias("c")).agg(F.sum("n").alias("n"))
        contexts = seen.groupBy("accepted", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        dense = seen.select("context").distinct().select("context", each).select("context", "c", kinds)
        joined = dense.join(seen, ["accepted", "context", "c"], "left").join(contexts, ["accepted", "context"], "left")
        if shorter is None:
            joined = joined.withColumn("below", F.lit(1.0 / len(SYMBOLS)))
        else:
            below = shorter.select("accepted", F.col("context").alias("suffix"), "c", F.col("p").alias("below"))
            joined = joined.withColumn("suffix", F.substring("context", 2, k - 1) if k > 1 else F.lit("")).join(below, ["accepted", "suffix", "c"])
        p = F.when(F.col("total") > 0, (F.coalesce("n", F.lit(0)) + F.col("kinds") * F.col("below")) / (F.col("total") + F.col("kinds"))).otherwise(F.col("below"))
        shorter = shared.written(joined.select("accepted", "context", "c", p.alias("p")), f"url-model-{k}")
        sign = F.when(F.col("accepted"), F.log("p")).otherwise(-F.log("p"))
        out.append(shorter.groupBy(F.concat("context", "c").alias(f"gram_{k}")).agg(F.sum(sign).alias(f"ratio_{k}")))
    return out


def _scored(texts: DataFrame, model: list[DataFrame]) -> DataFrame:
    """Distinct ``texts`` with the mean log-likelihood difference of their characters."""
    rows = texts.select("*", F.explode(_grams(F.col("text"))).alias("gram"))
    for k, table in enumerate(model):
        # At most len(SYMBOLS) ** (k + 1) rows.
        rows = rows.join(F.broadcast(table), F.substring("gram", ORDER + 1 - k, k + 1) == F.col(f"gram_{k}"), "left").drop(f"gram_{k}")
    ratio = reduce(lambda a, b: F.coalesce(a, b), (F.col(f"ratio_{k}") for k in range(ORDER, -1, -1)))
    return rows.groupBy(*texts.columns).agg(F.avg(ratio).alias("score"))


def _calibrated(scores: DataFrame) -> float:
    """The cut with the least sum of the two error rates over (accepted, score); the middle of the best cuts."""
    step = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) * STEPS).cast("int")
    # At most 2 * LIMIT * STEPS + 1 rows.
    bins = scores.groupBy(step.alias("step")).agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad")).orderBy("step").collect()
    good, bad = max(1, sum(r["good"] for r in bins)), max(1, sum(r["bad"] for r in bins))
    best, cuts, wrong = math.inf, [0.0], 0.0
    for r in bins:
        error = wrong + sum(x["bad"] for x in bins if x["step"] >= r["step"]) / bad
        if error < best - 1e-12:
            best, cuts = error, []
        if error <= best + 1e-12:
            cuts.append(r["step"] / STEPS)
        wrong += r["good"] / good
    return (cuts[0] + cuts[-1]) / 2


def judged(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict, and score (null where a rule decides).

    The rule of the longest text that fits decides; a rule's host fits itself and
    its subdomains. Else the score decides: ``allow`` from the calibrated cut on.
    A null URL, and one without ``://``, has an empty host and path and score 0.
    Where rules accept nothing, or reject nothing, there is no model and all else is
    allowed. Equal URLs are learned from once. No row is lost; columns of the
    names added are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "score")
    parsed = with_host_and_path(pages, url)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "__verdict": verdict, "__text": F.concat("host", "path")})
    texts = parsed.groupBy(F.col("__text").alias("text")).agg(F.max(F.col("__verdict") == "allow").alias("accepted"))
    texts = shared.written(texts.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(CALIBRATION_PARTS))), "url-texts")
    labelled = texts.where("accepted IS NOT NULL")
    counts = shared.written(labelled.where("part <> 0").select("accepted", F.explode(_grams(F.col("text"))).alias("gram")).groupBy("accepted", "gram").agg(F.count(F.lit(1)).alias("n")), "url-grams")
    if counts.select("accepted").distinct().count() < 2:
        return parsed.withColumns({"verdict": F.coalesce("__verdict", F.lit("allow")), "score": F.lit(None).cast("double")}).drop("__verdict", "__text")
    model = _model(counts)
    cut = _calibrated(_scored(labelled.where("part = 0").select("text", "accepted"), model))
    scores = shared.written(_scored(texts.where("accepted IS NULL").select("text"), model), "url-scores")
    joined = parsed.join(scores.withColumnRenamed("text", "__scored"), F.col("__text") == F.col("__scored"), "left")
    score = F.when(F.col("__verdict").isNull(), F.coalesce("score", F.lit(0.0)))
    said = F.coalesce("__verdict", F.when(F.coalesce("score", F.lit(0.0)) >= cut, "allow").otherwise("block"))
    return joined.withColumns({"verdict": said, "score": score}).select(*pages.columns, "host", "path", "rule", "verdict", "score")
