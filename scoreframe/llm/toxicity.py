"""Severity of toxic texts by cumulative-link ordinal regression on sparse word features.

Features of a text are its lower-cased words without punctuation at their ends and
the first 4, 5 and 6 bytes of longer words, as 64-bit hashes with counts, so
inflected forms share a feature. P(grade <= k) = logistic(threshold_k - w.x): one
weight a feature, shared by all grades, and ascending thresholds.

The labels only say toxic or not. Grade 0 is not toxic; labelled toxic texts are
graded 1 to ``GRADES`` by how many words tied to the toxic label are in them
(equal parts of the sample): a proxy, since no label says how toxic a text is, and
longer texts get higher grades by it. The share of such words as grade caught 0.51 of
held-out English toxic documents at sf0.1 in place of 0.92. Features are counted over every labelled document
and kept at a bounded share of false ones, so more labels find rarer words. Their
weights are fitted on at most ``MAX_LABELLED`` of those documents, drawn by label
(toxic ones first), and the thresholds are set back to the share of toxic labels
among all; scores are for every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.llm import ragged, shared

CHUNK_BYTES = 2 << 20
#: Labelled documents that the weights are fitted on, at most.
MAX_LABELLED = 12_000
#: Label rows (of 16 bytes) that may go to every task; where there are more, documents and labels meet by a merge join.
BROADCAST_LABELS = 2_000_000
#: Features kept, at most, and the share of them that may be kept by chance (Benjamini and Hochberg's bound).
MAX_FEATURES, FALSE_SHARE = 4096, 0.05
#: Bins of a unit of log chance, for the bound.
BINS = 4
GRADES = 3
PREFIXES = (4, 5, 6)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes and rows of all words and prefixes, and the number of words of each row."""
    data = ragged.LOWER_ASCII[data]
    starts, ends, row = ragged.word_spans(data, offsets)
    words = np.bincount(row, minlength=len(offsets) - 1)
    for _ in range(3):
        starts = starts + (_PUNCTUATION[data[starts]] & (ends - starts > 1))
        ends = ends - (_PUNCTUATION[data[ends - 1]] & (ends - starts > 1))
    features, rows = [ragged.span_hashes(data, starts, ends)], [row]
    padded = np.concatenate([data, np.zeros(max(PREFIXES), np.uint8)])
    packed = np.zeros(len(starts), np.uint64)
    for k in range(max(PREFIXES)):
        packed |= padded[starts + k].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in PREFIXES:
            longer = np.flatnonzero(ends - starts > k + 1)
            features.append(ragged.mix(packed[longer] + (np.uint64(k + 1) << np.uint64(56))))
            rows.append(row[longer])
    return np.concatenate(features), np.concatenate(rows), words


def _counted(features: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, sorted, and how often each stands."""
    order = np.lexsort((features, rows))
    features, rows = features[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (features[1:] != features[:-1]) | (rows[1:] != rows[:-1])
    start = np.flatnonzero(new)
    return features[start], rows[start], np.diff(start, append=len(rows))


class FeatureSet:
    """The kept features, and a quick test for most of the others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def columns(self, features: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Column and row of those that are kept."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(self.maybe[(features & np.uint64((1 << 20) - 1)).astype(np.int64)])
        features, rows = features[some], rows[some]
        at = np.minimum(np.searchsorted(self.hashes, features), len(self.hashes) - 1)
        kept = self.hashes[at] == features
        return at[kept], rows[kept]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Column, row and count of the kept features of some texts, and their numbers of words."""
        features, rows, words = word_features(data, offsets)
        column, row = self.columns(features, rows)
        column, row, count = _counted(column, row)
        return column, row, count, words


class OrdinalModel:
    """Shared weights and ascending thresholds of a cumulative-link (logistic) model."""

    def __init__(self, features: FeatureSet, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds

    @classmethod
    def fit(cls, features: FeatureSet, column, row, value, grade, penalty: float = 1e-5, steps: int = 600) -> OrdinalModel:
        """Adam on the mean negative log-likelihood plus ``penalty`` / 2 times the squared weights."""
        n, k, grades = len(grade), len(features.hashes), GRADES
        share = np.array([(np.sum(grade <= g) + 0.5) / (n + 1.0) for g in range(grades)])
        start = np.log(share / (1 - share))
        theta = np.concatenate([np.zeros(k), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            cuts = np.cumsum(np.concatenate([theta[k : k + 1], np.exp(theta[k + 1 :])]))
            z = np.bincount(row, theta[column] * value, n)
            upto = 1 / (1 + np.exp(-np.clip(np.concatenate([[np.full(n, -np.inf)], cuts[:, None] - z, [np.full(n, np.inf)]]), -500, 500)))
            upto[0], upto[-1] = 0, 1
            slope = upto * (1 - upto)
            at = np.arange(n)
            chance = np.maximum(upto[grade + 1, at] - upto[grade, at], 1e-12)
            up, low = slope[grade + 1, at] / chance, slope[grade, at] / chance
            pull = (up - low) / n
            g_cut = np.zeros(grades)
            np.add.at(g_cut, np.minimum(grade, grades - 1), np.where(grade < grades, -up / n, 0))
            np.add.at(g_cut, np.maximum(grade - 1, 0), np.where(grade > 0, low / n, 0))
            tail = np.cumsum(g_cut[::-1])[::-1]
            gradient = np.concatenate([np.bincount(column, pull[row] * value, k) + penalty * theta[:k], tail[:1], tail[1:] * np.exp(theta[k + 1 :])])
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        return cls(features, theta[:k], np.cumsum(np.concatenate([theta[k : k + 1], np.exp(theta[k + 1 :])])))

    def at_least(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1 .. GRADES, a column each."""
        column, row, count, _ = self.features.counts(data, offsets)
        z = np.bincount(row, self.weights[column] * np.log1p(count), len(offsets) - 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -500, 500)))


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Id, text and label of every labelled document that has a text."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg((F.max(F.col(label)) != 0).cast("int").alias("toxic"))
    chosen = chosen.hint("broadcast" if labels.count() <= BROADCAST_LABELS else "merge")
    return docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(chosen, F.col("__id") == F.col("__key")).select("text", "toxic", "__id")


def _drawn(labelled: DataFrame, n_bad: int, n_good: int, most: int) -> DataFrame:
    """Rows of at most ``most`` ids: toxic ones, then clean ones, those of the smallest hashes; where both are many, half each."""
    bad = min(n_bad, max(most - most // 2, most - n_good))
    ids = labelled.select(F.col("__id").alias("__key"), F.col("toxic").alias("__toxic")).distinct()
    parts = [ids.where(F.col("__toxic") == is_bad).orderBy(F.xxhash64("__key"), "__key").limit(n) for is_bad, n in ((1, bad), (0, most - bad))]
    return labelled.join(F.broadcast(parts[0].union(parts[1])), F.col("__id") == F.col("__key"))


def _kept(counts: DataFrame, n_bad: int, n_good: int) -> list:
    """Features tied to the label, at most ``MAX_FEATURES``, with how many more toxic documents they have than their share (z).

    A feature's chance under no tie is bounded by Chernoff's bound on the binomial
    tail, which holds for few documents too. Benjamini and Hochberg's step-up bound
    on the counts of its bins gives the chance up to which features are kept; features too
    rare to get below ``FALSE_SHARE`` in any case are no tests. Of more than
    ``MAX_FEATURES``, those of the largest cautious log odds ratio stay, that is less two standard errors.
    """
    share, n = n_bad / (n_bad + n_good), F.col("bad") + F.col("good")

    def part(x: str, p: float):
        return F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (n * p))).otherwise(0.0)

    ratio = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - float(np.log(n_bad / n_good))
    sure = F.abs(ratio) - 2 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    tested = counts.where(n * float(-np.log(min(share, 1 - share))) >= float(-np.log(FALSE_SHARE / 2)))
    tested = tested.select("feature", (part("bad", share) + part("good", 1 - share)).alias("far"), (F.col("bad") - n * share).alias("z"), sure.alias("sure"))
    # Chances are bounded by 2 exp(-far); a bin stands for the largest chance in it.
    bins = sorted((r["bin"], r["count"]) for r in tested.groupBy(F.least(F.floor(F.col("far") * BINS), F.lit(4000)).alias("bin")).count().collect())
    total, above, cut = sum(c for _, c in bins), 0, None
    for i, count in reversed(bins):
        above += count
        if np.log(2 * total) - i / BINS <= np.log(FALSE_SHARE * above):
            cut = i
    if cut is None:
        return []
    return tested.where(F.col("far") >= cut / BINS).orderBy(F.col("sure").desc(), F.col("far").desc(), "feature").limit(MAX_FEATURES).select("feature", "z").collect()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED) -> OrdinalModel:
    """The model of ``labels`` (null labels are ignored; a document labelled twice counts as its largest label).

    Without any toxic label, or any clean one, no feature is kept and every text has severity near the sample's share.
    """
    labelled = shared.written(_labelled(docs, labels, key, text, label), "labelled")

    def presence(batches):
        for batch in batches:
            toxic = np.asarray(batch.column(1))
            _, offsets = ragged.text_bytes(batch.column(0))
            for i, j in ragged.row_slices(offsets, CHUNK_BYTES):
                features, rows, _ = word_features(*ragged.text_bytes(batch.column(0).slice(i, j - i)))
                features, rows, _ = _counted(features, rows)
                found, which = np.unique(features, return_inverse=True)
                bad = toxic[i:j][rows] != 0
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(which, bad, len(found)).astype(np.int64)), pa.array(np.bincount(which, ~bad, len(found)).astype(np.int64))], ["feature", "bad", "good"])

    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    counts = labelled.select("text", "toxic").mapInArrow(presence, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    kept = []
    if n_bad and n_good:
        counts = shared.written(counts.where(F.col("bad") + F.col("good") > 1), "features")
        kept = _kept(counts, n_bad, n_good)
        shared.discard(counts)
    features = FeatureSet(np.array([r["feature"] for r in kept], np.int64).view(np.uint64))
    signs = dict(zip(np.array([r["feature"] for r in kept], np.int64).view(np.uint64).tolist(), [r["z"] for r in kept], strict=True))
    marks = np.array([signs[h] > 0 for h in features.hashes.tolist()], bool)

    def encoded(batches):
        for batch in batches:
            toxic = np.asarray(batch.column(1))
            _, offsets = ragged.text_bytes(batch.column(0))
            for i, j in ragged.row_slices(offsets, CHUNK_BYTES):
                column, row, count, _ = features.counts(*ragged.text_bytes(batch.column(0).slice(i, j - i)))
                amount = np.bincount(row, count * marks[column], j - i).astype(np.float64)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                parts = list(zip(cut[:-1], cut[1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(toxic[i:j].astype(np.int64)), pa.array(amount), *(ragged.binary_column([x[a:b] for a, b in parts]) for x in (column.astype(np.uint16), count.astype(np.uint32)))], ["toxic", "amount", "columns", "counts"])

    # At most ``most`` rows of at most MAX_FEATURES entries come to the driver.
    rows = _drawn(labelled, n_bad, n_good, most).select("text", "toxic").mapInArrow(encoded, "toxic long, amount double, columns binary, counts binary").orderBy("toxic", "amount", "columns", "counts").collect()
    shared.discard(labelled)
    if not rows or not len(features.hashes):
        risk = (n_bad + 0.5) / (n_bad + n_good + 1)
        return OrdinalModel(features, np.zeros(len(features.hashes)), np.full(GRADES, np.log((1 - risk) / risk)) + np.arange(GRADES))
    columns = [np.frombuffer(r["columns"], np.uint16).astype(np.int64) for r in rows]
    value = np.log1p(np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]).astype(float))
    row = np.repeat(np.arange(len(rows)), [len(c) for c in columns])
    bad, amount = np.array([r["toxic"] for r in rows]) != 0, np.array([r["amount"] for r in rows])
    steps = np.quantile(amount[bad], np.arange(1, GRADES) / GRADES)
    grade = np.where(bad, 1 + np.searchsorted(steps, amount, "right"), 0)
    model = OrdinalModel.fit(features, np.concatenate(columns), row, value, grade)
    # Toxic rows are drawn more often than clean ones; only the thresholds depend on that.
    drawn = np.log(np.sum(bad) / np.sum(~bad)) - np.log(n_bad / n_good)
    return OrdinalModel(features, model.weights, model.thresholds + drawn)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", reject_at: float = 0.2, prefix: str = "") -> DataFrame:
    """``docs`` with p_grade_1 .. p_grade_3 (chance of that grade or more), expected_severity (their sum) and rejected, all behind ``prefix``.

    A text is rejected if its chance of grade 1 or more is ``reject_at`` or more and
    its odds are ten times those of a text without features, at least: few labels
    with many toxic ones among them don't reject texts that nothing is known of.
    Null and empty texts have no feature and take the model's base chance. No row
    is lost; columns of those names are replaced.
    """
    names = [prefix + n for n in (*(f"p_grade_{g}" for g in range(1, GRADES + 1)), "expected_severity", "rejected")]
    docs = docs.drop(*names)
    cut = max(np.log(reject_at / (1 - reject_at)), np.log(10) - model.thresholds[0])
    cut = 1 / (1 + np.exp(-cut))
    schema = T.StructType([*docs.schema, *(T.StructField(n, T.DoubleType()) for n in names[:-1]), T.StructField(names[-1], T.BooleanType())])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, offsets = ragged.text_bytes(column)
            for i, j in ragged.row_slices(offsets, CHUNK_BYTES):
                chance = model.at_least(*ragged.text_bytes(column.slice(i, j - i)))
                extra = [*chance.T, chance.sum(axis=1), chance[:, 0] >= cut]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *map(pa.array, extra)], schema.names)

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The ``docs`` that aren't rejected, with their own columns as they are."""
    return score(docs, model, text, prefix="__sf_").where("NOT __sf_rejected").select(*docs.columns)
