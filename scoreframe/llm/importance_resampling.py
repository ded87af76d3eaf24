"""Documents drawn by how much more often their hashed n-grams stand in a target text than in the corpus.

Words are found by an Aho-Corasick automaton over delimiter-bounded words
(``" word "``), each with its CRC-32 and byte length as payload. A scan emits the
payloads of all words in the automaton in one pass; words that aren't in it get
their payload from their bytes and enter it for later texts, up to a bound. So the
automaton saves work and never changes a result.

A feature is a run of one to three words joined by a space. Its CRC-32 is composed
of its words' payloads: crc(x + y) = shift(crc(x), len(y)) ^ crc(y), where shift is
linear in its bits and read from tables by length. No n-gram is ever built as text.

The buckets of each document are written once, two bytes a feature, and read to
count and to weigh, so texts are scanned once. Counts are one array of ``BUCKETS``
numbers a task, added up by Spark; the gains are as many numbers, whatever the
number of documents, and go to all tasks. Ranks come from ranges of the scores that
are numbered apart.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.llm import ragged, shared

CHUNK_BYTES = 2 << 20
BUCKETS, LONGEST = 10_000, 3
#: Drawn documents are so many hundredths of those with LEAST_WORDS words.
SHARE, LEAST_WORDS, SEED = 5, 20, 42
#: Words and their bytes that an automaton holds at most; longer words than LONGEST_WORD never enter it.
MOST_WORDS, MOST_WORD_BYTES, LONGEST_WORD = 60_000, 1 << 20, 64
#: Lengths whose shift is one table; longer ones are shifted in several steps.
TABLE_LENGTHS = 128
_LENGTH_BITS = 32

#: Bytes outside words are a space; A-Z are lower-cased; bytes of characters outside ASCII stay.
_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)


def _byte_table() -> np.ndarray:
    """The CRC-32 register after each byte value alone (polynomial 0xEDB88320, reflected)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1)).astype(np.uint32)
    return table


@lru_cache(maxsize=1)
def shift_tables() -> np.ndarray:
    """[length, byte of the CRC, its value]: what that byte turns into when ``length`` bytes follow."""
    step = _byte_table()
    tables = np.zeros((TABLE_LENGTHS, 4, 256), np.uint32)
    tables[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(1, TABLE_LENGTHS):
        tables[n] = (tables[n - 1] >> np.uint32(8)) ^ step[tables[n - 1] & np.uint32(0xFF)]
    return tables


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The part of crc(x + y) that comes from x, of CRC ``crc``, where y has ``length`` bytes."""
    flat, most = shift_tables().reshape(-1), TABLE_LENGTHS - 1
    crc, left = crc.astype(np.uint32), length.astype(np.int64)
    while True:
        base = np.minimum(left, most) * 1024
        crc = flat[base + (crc & 0xFF)] ^ flat[base + 256 + ((crc >> 8) & 0xFF)] ^ flat[base + 512 + ((crc >> 16) & 0xFF)] ^ flat[base + 768 + (crc >> 24)]
        left = left - np.minimum(left, most)
        if not (left > 0).any():
            return crc


class WordDictionary:
    """The words met so far by one Python worker, as an automaton that emits each one's CRC-32 and length."""

    def __init__(self, most: int = MOST_WORDS, most_bytes: int = MOST_WORD_BYTES):
        self.most, self.most_bytes = most, most_bytes
        self.words: set[bytes] = set()
        self.used = self.built = 0
        self.automaton: ahocorasick.Automaton | None = None

    def _learn(self, found: dict[bytes, int]) -> None:
        """New words enter; the automaton is built anew each time the words have grown by half, so building stays linear."""
        for word in found:
            if len(word) <= LONGEST_WORD and len(self.words) < self.most and self.used + len(word) <= self.most_bytes:
                self.words.add(word)
                self.used += len(word)
        if len(self.words) > 1.5 * self.built or len(self.words) == self.most > self.built:
            self.automaton, self.built = ahocorasick.Automaton(), len(self.words)
            for word in self.words:
                self.automaton.add_word(f" {word.decode('latin-1')} ", zlib.crc32(word) | len(word) << _LENGTH_BITS)
            self.automaton.make_automaton()

    def payloads(self, clean: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The CRC-32 of each word; ``clean`` begins and ends with a space and has the words at the given places."""
        crc, known = np.zeros(len(starts), np.uint32), np.zeros(len(starts), bool)
        raw = clean.tobytes()
        if self.automaton is not None:
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(raw.decode("latin-1"))), np.int64)
            at, payload = hits[0::2], hits[1::2]
            place = np.searchsorted(starts, at - (payload >> _LENGTH_BITS))
            crc[place], known[place] = (payload & 0xFFFFFFFF).astype(np.uint32), True
        missing = np.flatnonzero(~known)
        if len(missing):
            words = [raw[a:b] for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
            found = {w: zlib.crc32(w) for w in dict.fromkeys(words)}
            crc[missing] = np.fromiter((found[w] for w in words), np.uint32, len(words))
            self._learn(found)
        return crc


@lru_cache(maxsize=1)
def word_dictionary() -> WordDictionary:
    return WordDictionary()


def features(dictionary: WordDictionary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each feature of all rows, and each row's number of words."""
    rows = len(offsets) - 1
    # A space after each row keeps rows apart; one stands before the first.
    clean = np.full(len(data) + rows + 1, 0x20, np.uint8)
    clean[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))] = _CLEAN[data]
    starts, ends, row = ragged.word_spans(clean, np.concatenate([offsets[:-1] + np.arange(rows) + (np.arange(rows) > 0), [len(clean)]]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    length, crc = ends - starts, dictionary.payloads(clean, starts, ends)
    space = np.uint32(zlib.crc32(b" "))
    found, owners, run = [crc], [row], crc
    for size in range(2, LONGEST + 1):
        # The run that begins at word i and has size words: the one of size - 1, a space, and word i + size - 1.
        run, last = run[:-1], slice(size - 1, None)
        run = shifted(run, length[last] + 1) ^ shifted(np.full(len(run), space), length[last]) ^ crc[last]
        inside = row[: len(run)] == row[last]
        found.append(run[inside]), owners.append(row[last][inside])
    return np.concatenate(owners), np.concatenate(found).astype(np.int64) % BUCKETS, np.bincount(row, minlength=rows)


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words and the buckets of all features (16 bits each) of each of the ``docs``."""
    schema = docs.select(F.col(key), F.lit(0).cast("long").alias("n_words"), F.lit(b"").alias("buckets")).schema

    def run(batches):
        for batch in batches:
            for i, j in ragged.row_slices(ragged.text_bytes(batch.column(1))[1], CHUNK_BYTES):
                row, bucket, words = features(word_dictionary(), *ragged.text_bytes(batch.column(1).slice(i, j - i)))
                found = bucket[np.argsort(row, kind="stable")].astype("<u2")
                ends = np.cumsum(np.bincount(row, minlength=j - i)).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words.astype(np.int64)), ragged.binary_column([found[a:b] for a, b in zip([0, *ends], ends, strict=False)])], schema.names)

    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, schema)


def bucket_counts(hashes: DataFrame) -> np.ndarray:
    """How many features of all :func:`hashed` texts fall into each bucket; a task sends one count a bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in batch.column(0):
                total += np.bincount(np.frombuffer(part.as_buffer(), "<u2"), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    sums = hashes.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature in each bucket adds to a document's weight: thousandths of the log ratio of smoothed shares, floored."""
    s, t, all_s, all_t = corpus.astype(float), target.astype(float), float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).astype(np.int64)


def weighed(hashes: DataFrame, gains: np.ndarray, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_features and weight of each :func:`hashed` document."""
    schema = hashes.select(F.col(key), *(F.lit(0).cast("long").alias(c) for c in ("n_words", "n_features", "weight"))).schema

    def run(batches):
        for batch in batches:
            parts = [np.frombuffer(part.as_buffer(), "<u2") for part in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(p) for p in parts], pa.int64()), pa.array([int(gains[p].sum()) for p in parts], pa.int64())], schema.names)

    return hashes.select(F.col(key), "n_words", "buckets").mapInArrow(run, schema)


def scored(weights: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``weights`` with score: the weight and a Gumbel number that the key alone decides."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return weights.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))))


def drawn(scores: DataFrame, key: str = "doc_id", share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scores`` with rank: the place among the best ``share`` hundredths of the documents of ``least_words`` words; null for the others.

    Ranges of the order are sorted apart and each row gets its place in its range;
    what the ranges before hold is one row a range.
    """
    out = scores.columns
    able = F.col("n_words") >= least_words
    ordered = scores.withColumn("__out", F.when(able, 0).otherwise(1))
    order = [F.col("__out"), F.col("score").desc(), F.col(key)]
    placed = ordered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranges = shared.written(placed.select(*out, "__out", F.shiftright("__at", 33).alias("__range"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__at")), "ranked")
    held = ranges.where("__out = 0").groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = held.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    place = F.col("__before") + F.col("__at") + 1
    rank = F.when((F.col("__out") == 0) & (place <= F.floor(share * F.col("__all") / 100)), place)
    return ranges.join(F.broadcast(before), F.col("__range") == F.col("__r"), "left").select(*out, rank.cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's key, n_words, n_features, weight, score and rank in the draw (null: not drawn).

    A null, empty or wordless text has no feature and weight 0; it can't be drawn.
    A null key is drawn by the hash of the bare seed. Rows with one key are told
    apart by nothing but their scores, so equal rows take neighbouring ranks. An
    empty target or table is fine: all shares are then equal. One row for each
    input row; other columns aren't read, and ``target`` needs ``text`` only.
    """
    hashes = shared.written(hashed(docs, key, text), "hashed-features", compression="zstd")
    of_target = hashed(target.select(F.lit(0).alias("__id"), F.col(text)), "__id", text)
    gains = bucket_gains(bucket_counts(hashes), bucket_counts(of_target))
    scores = shared.written(scored(weighed(hashes, gains, key), key), "scores")
    shared.discard(hashes)
    return drawn(scores, key)
