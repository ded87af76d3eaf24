"""Bigram language model by deleted interpolation, and the log-probability of every document.

P(w | v) = l(b) * c(v w) / c(v) + (1 - l(b)) * P(w), where b is the power of two
of c(v), and P(w) = m * c(w) / N + (1 - m) / (V + 1). The weights m and l(b) are
learned by expectation-maximisation on held-out counts: of the training documents,
one part gives the maximum-likelihood estimates and the other the counts that the
weights must explain. The final estimates use all training documents.

Work: documents turn into chunks of token numbers, written once. Each chunk sends
each distinct word (then each distinct pair) once, with its counts, to a bucket of
the key's range; a bucket sums and sends the totals back in the order asked. A
word in every document so costs one entry a chunk, and no table of counts is ever
held whole. Buckets follow the number of keys. The weights' EM needs only a
histogram of held-out counts by context bucket and ratio of the two estimates
(1/32 of an octave wide), whose size is fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm import ragged, shared

#: Tokens of a chunk, about, and bytes of text read at a time.
CHUNK_TOKENS, CHUNK_BYTES = 1_500_000, 4 << 20
#: Distinct keys that a bucket is asked for, about.
BUCKET_KEYS = 1_000_000
#: Of FOLDS parts by the CRC-32 of the key, part 0 is not learned from and part DEV teaches the weights.
FOLDS, DEV = 10, 1
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Added to the fold of a document without a key.
NO_KEY = 128
#: Histogram: octaves of the ratio below 1, all octaves, bins an octave; context buckets.
LOW, OCTAVES, FINE, CONTEXTS = 64, 160, 32, 64
_BINS = OCTAVES * FINE + 1


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences of the fewest whole bytes."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    rest = int(steps[1:].max()) if len(keys) > 1 else 0
    wide = max(1, (rest.bit_length() + 7) // 8)
    return bytes([wide]) + keys[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    wide = raw[0]
    rest = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, wide)
    steps = np.zeros((len(rest) + 1, 8), np.uint8)
    steps[0], steps[1:, :wide] = np.frombuffer(raw, np.uint8, 8, 1), rest
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 or more follow in eight."""
    large = counts >= 255
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype(np.int64).tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.int64, offset=n)
    return out


class _Chunk:
    """Documents of one kind on their way into a row of the chunk table."""

    def __init__(self, dev: bool):
        self.dev = dev
        self.clear()

    def clear(self) -> None:
        self.words, self.ids, self.folds, self.sizes, self.n = [], [], [], [], 0

    def add(self, words, ids, folds, sizes) -> None:
        self.words.append(words), self.ids.append(ids), self.folds.append(folds), self.sizes.append(sizes)
        self.n += len(words)

    def row(self, number: int) -> pa.RecordBatch:
        words, place = np.unique(np.concatenate(self.words), return_inverse=True)
        ids, folds, sizes = (np.concatenate(x) for x in (self.ids, self.folds, self.sizes))
        pairs = len(np.unique(_pair_codes(place, sizes, len(words))))
        part = folds & (NO_KEY - 1)
        trained = int(sizes[part != 0].sum())
        out = [[number], [self.dev], [len(words)], [pairs], [trained], [trained - int(sizes[part == DEV].sum())]]
        blobs = [ids.astype(np.int64).tobytes(), folds.astype(np.uint8).tobytes(), sizes.astype(np.uint32).tobytes(), pack_sorted(words), place.astype(np.uint32).tobytes()]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out] + [pa.array([pa.compress(b, "zstd", asbytes=True)], pa.binary()) for b in blobs] + [pa.array([[len(b) for b in blobs]], pa.list_(pa.int64()))], _CHUNK_COLUMNS)


_CHUNK_COLUMNS = ["chunk", "dev", "n_words", "n_pairs", "trained", "fitted", "ids", "folds", "sizes", "words", "places", "raw"]
_CHUNK_SCHEMA = "chunk long, dev boolean, n_words long, n_pairs long, trained long, fitted long, ids binary, folds binary, sizes binary, words binary, places binary, raw array<long>"


def _pair_codes(place: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """A number for each token's pair with the token before it; number n stands for a document's start."""
    before = np.empty(len(place), np.int64)
    before[1:] = place[:-1]
    before[np.cumsum(sizes) - sizes] = n
    return before * (n + 1) + place


class Tokens:
    """A row of the chunk table, unpacked."""

    def __init__(self, row: dict):
        ids, folds, sizes, words, places = (pa.decompress(row[c], n, "zstd", asbytes=True) for c, n in zip(("ids", "folds", "sizes", "words", "places"), row["raw"], strict=True))
        folds = np.frombuffer(folds, np.uint8)
        self.ids, self.no_key, self.folds, self.sizes = np.frombuffer(ids, np.int64), folds >= NO_KEY, folds & (NO_KEY - 1), np.frombuffer(sizes, np.uint32).astype(np.int64)
        self.words, self.place = unpack_sorted(words), np.frombuffer(places, np.uint32).astype(np.int64)
        self.fold = np.repeat(self.folds, self.sizes)
        self.n = len(self.words)

    def word_keys(self) -> tuple[np.ndarray, np.ndarray]:
        return self.words, self.place

    def pair_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs' keys, ascending, and each token's pair."""
        codes, which = np.unique(_pair_codes(self.place, self.sizes, self.n), return_inverse=True)
        context = np.append(self.words, START)[codes // (self.n + 1)]
        keys = ragged.mix(ragged.mix(context) + self.words[codes % (self.n + 1)])
        order = np.argsort(keys)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return keys[order], back[which]

    def contexts(self, counts: np.ndarray, starts: int) -> np.ndarray:
        """How often the token before each token stands in ``counts`` of words; a start as often as there are documents."""
        before = np.append(counts, starts)
        codes = np.empty(self.place.shape, np.int64)
        codes[1:] = self.place[:-1]
        codes[np.cumsum(self.sizes) - self.sizes] = self.n
        return before[codes]


def token_chunks(docs: DataFrame) -> DataFrame:
    """Of ``docs`` (id, text, fold): the chunk table. DEV documents have chunks of their own."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        kinds = (_Chunk(False), _Chunk(True))
        for batch in batches:
            _, offsets = ragged.text_bytes(batch.column(1))
            ids, folds = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for i, j in ragged.row_slices(offsets, CHUNK_BYTES):
                data, at = ragged.text_bytes(batch.column(1).slice(i, j - i))
                data = ragged.LOWER_ASCII[data]
                starts, ends, row = ragged.word_spans(data, at)
                counts = np.bincount(row, minlength=j - i)
                words = np.full(len(starts) + j - i, END, np.uint64)
                stop = np.zeros(len(words), bool)
                stop[np.cumsum(counts + 1) - 1] = True
                words[~stop] = ragged.span_hashes(data, starts, ends)
                dev = folds[i:j] & (NO_KEY - 1) == DEV
                of = np.repeat(dev, counts + 1)
                for kind, chunk in zip((False, True), kinds, strict=True):
                    if (dev == kind).any():
                        chunk.add(words[of == kind], ids[i:j][dev == kind], folds[i:j][dev == kind], (counts + 1)[dev == kind])
                    if chunk.n >= CHUNK_TOKENS:
                        yield chunk.row(number)
                        number += 1
        for chunk in kinds:
            if chunk.n:
                yield chunk.row(number)
                number += 1

    return docs.mapInArrow(run, _CHUNK_SCHEMA)


def _requests(chunks: DataFrame, buckets: int, pairs: bool) -> DataFrame:
    """A row for each chunk and bucket: distinct keys, ascending, and their counts in the fitting and the DEV part."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens = Tokens(row)
                keys, which = tokens.pair_keys() if pairs else tokens.word_keys()
                fit = np.bincount(which[tokens.fold > DEV], minlength=len(keys))
                dev = np.bincount(which[tokens.fold == DEV], minlength=len(keys))
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                parts = ragged.runs(bucket)
                cut = [a for a, _ in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut]), pa.array(np.full(len(cut), row["chunk"], np.int64)), pa.array(np.full(len(cut), row["dev"])), *(pa.array([f(x[a:b]) for a, b in parts], pa.binary()) for f, x in ((pack_sorted, keys), (pack_counts, fit), (pack_counts, dev)))],
                    ["bucket", "chunk", "dev", "keys", "fit", "held"],
                )

    return chunks.mapInArrow(run, "bucket long, chunk long, dev boolean, keys binary, fit binary, held binary")


def _totals(table: pa.Table) -> pa.Table:
    """Answers to a bucket's requests; its first row also has the bucket's numbers of trained and fitted keys, and a histogram of held-out counts by fitted count."""
    rows = table.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    fit, dev = (np.bincount(which, np.concatenate([unpack_counts(r[c], len(k)) for r, k in zip(rows, keys, strict=True)]), len(distinct)).astype(np.int64) for c in ("fit", "held"))
    ends = np.cumsum([len(k) for k in keys])
    held = dev > 0
    cell = np.where(fit > 0, 1 + np.floor(np.log2(np.maximum(fit, 1)) * FINE).astype(np.int64), 0)[held]
    cells, place = np.unique(cell, return_inverse=True)
    weights = np.bincount(place, dev[held], len(cells)) if len(cells) else np.zeros(0)
    out = {"chunk": [], "bucket": [], "fit": [], "every": [], "trained_keys": [], "fitted_keys": [], "cells": [], "weights": []}
    for n, (r, k, e) in enumerate(zip(rows, keys, ends.tolist(), strict=True)):
        mine = which[e - len(k) : e]
        out["chunk"].append(r["chunk"]), out["bucket"].append(r["bucket"])
        out["fit"].append(pack_counts(fit[mine]) if r["dev"] else b""), out["every"].append(pack_counts(fit[mine] + dev[mine]))
        out["trained_keys"].append(int(((fit + dev) > 0).sum()) if n == 0 else 0), out["fitted_keys"].append(int((fit > 0).sum()) if n == 0 else 0)
        out["cells"].append(cells.tolist() if n == 0 else []), out["weights"].append(weights.tolist() if n == 0 else [])
    return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("fit", pa.binary()), ("every", pa.binary()), ("trained_keys", pa.int64()), ("fitted_keys", pa.int64()), ("cells", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64()))]))


_TOTALS_SCHEMA = "chunk long, bucket long, fit binary, every binary, trained_keys long, fitted_keys long, cells array<long>, weights array<double>"


def _spread(table: DataFrame, by: str, groups: int) -> DataFrame:
    """``table`` dealt by ``by`` to enough partitions for its number of groups, so that tasks stay small as these grow."""
    return table.repartition(max(2 * groups, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))), by)


def counted(chunks: DataFrame, asked: int, pairs: bool) -> DataFrame:
    """Total counts of every chunk's words or pairs, a row for each chunk and bucket, written."""
    buckets = max(1, -(-asked // BUCKET_KEYS))
    requests = _spread(_requests(chunks, buckets, pairs), "bucket", buckets)
    return shared.written(requests.groupBy("bucket").applyInArrow(_totals, _TOTALS_SCHEMA), "pair-counts" if pairs else "word-counts", compression="zstd")


def _unpack(answers: list[dict], keys: np.ndarray, buckets: int, column: str) -> np.ndarray:
    """One count for each of the ascending ``keys``."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    by = {r["bucket"]: r[column] for r in answers}
    return np.concatenate([unpack_counts(by[int(bucket[a])], b - a) for a, b in ragged.runs(bucket)] or [np.zeros(0, np.int64)])


def learned_share(weights: np.ndarray, ratio: np.ndarray, rounds: int = 200) -> float:
    """EM for the weight of the first of two estimates; ``ratio`` is first over second, ``weights`` the held-out counts."""
    total, share = weights.sum(), 0.5
    if not total:
        return 0.0
    for _ in range(rounds):
        with np.errstate(invalid="ignore"):
            part = np.where(np.isinf(ratio), 1.0, share * ratio / (share * ratio + 1 - share))
        share = min(float((weights * part).sum() / total), 1 - 1e-6)
    return share


class Weights:
    """Counts of the corpus and the learned weights: all that the formula needs beside counts of words and pairs."""

    def __init__(self, tokens: int, words: int, starts: int, unigram: float, contexts: np.ndarray | None = None):
        self.tokens, self.words, self.starts, self.unigram, self.contexts = tokens, words, starts, unigram, contexts

    def word_chance(self, count: np.ndarray) -> np.ndarray:
        return self.unigram * count / max(self.tokens, 1) + (1 - self.unigram) / (self.words + 1)

    def chance(self, pair: np.ndarray, context: np.ndarray, count: np.ndarray) -> np.ndarray:
        share = np.where(context > 0, self.contexts[context_bucket(context)], 0.0)
        return share * pair / np.maximum(context, 1) + (1 - share) * self.word_chance(count)


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))).astype(np.int64), 0)


def scored_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's log10 probabilities: key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Words are runs of other bytes than 0x20 and 0x09 to 0x0D, A-Z lower-cased, and
    one end follows. A null text is empty: it has the end only. Documents whose
    CRC-32 of the key as text is divisible by 10 are held out and not learned from;
    a missing key counts as empty text and is held out. base_score is the unigram
    score with 0.1 added to each count. Words and pairs are told apart by 64-bit
    hashes. Keys are whole numbers (others end in Spark's cast error). Equal rows each
    have a row; other columns aren't read. With nothing to learn from, every word has
    the same chance.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    fold = fold + F.when(F.col(key).isNull(), NO_KEY).otherwise(0)
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.col(text).alias("text"), fold.alias("fold"))
    chunks = shared.written(token_chunks(source), "tokens")
    sizes = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_pairs", "trained", "fitted")), F.count(F.lit(1)).alias("chunks")).first()
    word_buckets, pair_buckets = (max(1, -(-sizes[c] // BUCKET_KEYS)) for c in ("n_words", "n_pairs"))

    words = counted(chunks, sizes["n_words"], False)
    kinds = words.agg(F.coalesce(F.sum("trained_keys"), F.lit(0)).alias("t"), F.coalesce(F.sum("fitted_keys"), F.lit(0)).alias("f")).first()
    # A document has one end, so the end's count is the number of documents that start.
    starts = _document_counts(chunks)
    cells = words.select(F.explode(F.arrays_zip("cells", "weights")).alias("x")).groupBy("x.cells").agg(F.sum("x.weights").alias("w")).orderBy("cells").collect()
    count = np.array([0.0 if r["cells"] == 0 else 2.0 ** ((r["cells"] - 0.5) / FINE) for r in cells])
    unigram = learned_share(np.array([r["w"] for r in cells]), count / max(sizes["fitted"], 1) * (kinds["f"] + 1))
    fitted = Weights(sizes["fitted"], kinds["f"], starts["fitted"], unigram)

    pairs = counted(chunks, sizes["n_pairs"], True)
    answers = words.select("chunk", F.lit(False).alias("pairs"), "bucket", "fit", "every").union(pairs.select("chunk", F.lit(True).alias("pairs"), "bucket", "fit", "every"))

    def ratios(chunk: pa.Table, said: pa.Table) -> pa.Table:
        rows = said.to_pylist()
        cell = []
        for row in chunk.to_pylist():
            tokens = Tokens(row)
            keys, which = tokens.pair_keys()
            word = _unpack([r for r in rows if not r["pairs"]], tokens.words, word_buckets, "fit")
            pair = _unpack([r for r in rows if r["pairs"]], keys, pair_buckets, "fit")[which]
            context = tokens.contexts(word, fitted.starts)
            known = context > 0
            ratio = (pair[known] / context[known]) / fitted.word_chance(word[tokens.place[known]])
            with np.errstate(divide="ignore"):
                bins = np.where(ratio > 0, np.clip(1 + np.floor((np.log2(ratio) + LOW) * FINE), 1, _BINS - 1), 0).astype(np.int64)
            cell.append(context_bucket(context[known]) * _BINS + bins)
        cells, n = np.unique(np.concatenate(cell), return_counts=True) if cell else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(n, pa.int64())})

    # The histogram has at most CONTEXTS * _BINS cells, whatever the corpus.
    dev = chunks.where("dev")
    found = dev.groupBy("chunk").cogroup(answers.join(dev.select(F.col("chunk").alias("__chunk")), F.col("chunk") == F.col("__chunk"), "left_semi").groupBy("chunk")).applyInArrow(ratios, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    histogram = np.zeros(CONTEXTS * _BINS)
    histogram[[r["cell"] for r in found]] = [r["n"] for r in found]
    ratio = np.concatenate([[0.0], 2.0 ** ((np.arange(1, _BINS) - 0.5) / FINE - LOW)])
    shares = np.array([learned_share(h, ratio) for h in histogram.reshape(CONTEXTS, _BINS)])
    final = Weights(sizes["trained"], kinds["t"], starts["trained"], unigram, shares)

    schema = docs.select(F.col(key), F.lit(True).alias("held_out"), *(F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")), *(F.lit(0.0).alias(c) for c in ("base_score", "score", "perplexity"))).schema

    def scores(chunk: pa.Table, said: pa.Table) -> pa.Table:
        rows, out = said.to_pylist(), []
        for row in chunk.to_pylist():
            tokens = Tokens(row)
            keys, which = tokens.pair_keys()
            word = _unpack([r for r in rows if not r["pairs"]], tokens.words, word_buckets, "every")
            pair = _unpack([r for r in rows if r["pairs"]], keys, pair_buckets, "every")[which]
            count = word[tokens.place]
            doc = np.repeat(np.arange(len(tokens.ids)), tokens.sizes)
            score = np.bincount(doc, np.log10(final.chance(pair, tokens.contexts(word, final.starts), count)), len(tokens.ids))
            base = np.bincount(doc, np.log10((count + 0.1) / (final.tokens + 0.1 * (final.words + 1))), len(tokens.ids))
            known = np.bincount(doc, count > 0, len(tokens.ids)).astype(np.int64)
            ids = pc.if_else(pa.array(tokens.no_key), None, pa.array(tokens.ids))
            out.append(pa.table([ids, pa.array(tokens.folds == 0), pa.array(tokens.sizes), pa.array(known), pa.array(np.full(len(doc) and len(tokens.ids), final.tokens, np.int64)), pa.array(base), pa.array(score), pa.array(10.0 ** (-score / tokens.sizes))], names=schema.names))
        return pa.concat_tables(out)

    spread = (_spread(table, "chunk", sizes["chunks"]).groupBy("chunk") for table in (chunks, answers))
    return next(spread).cogroup(next(spread)).applyInArrow(scores, schema)


def _document_counts(chunks: DataFrame) -> dict[str, int]:
    """Numbers of training documents and of those in the fitting part."""

    def run(batches):
        for batch in batches:
            trained = fitted = 0
            for folds, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fold = np.frombuffer(pa.decompress(folds, raw[1], "zstd", asbytes=True), np.uint8) & (NO_KEY - 1)
                trained, fitted = trained + int((fold != 0).sum()), fitted + int((fold > DEV).sum())
            yield pa.RecordBatch.from_arrays([pa.array([trained]), pa.array([fitted])], ["trained", "fitted"])

    row = chunks.select("folds", "raw").mapInArrow(run, "trained long, fitted long").agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("trained"), F.coalesce(F.sum("fitted"), F.lit(0)).alias("fitted")).first()
    return row.asDict()
