"""Tokens of two tokenizers aligned by the byte offsets at which both have an end.

Both encode the same bytes, so a token's end is a sum of its predecessors' bytes.
An end-to-index dictionary of each side (an array over the batch's bytes, which is a
perfect hash of offsets) is intersected with the other's; the common ends, in
order, slice both id lists into groups, and each slice gives its links: the two
tokens that end there.

Two tokens that end together have one's bytes as a suffix of the other's. So a pair
is named by the longer token and the shorter one's length, and the vocabularies
alone bound the number of pairs (the sum of their tokens' bytes, some half a
million), whatever the number of documents. Counts are one array of that length:
added up by Spark, then sent to all tasks. No link is shuffled or joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.llm import ragged, sentencepiece_codec, shared, token_files

CHUNK_BYTES = 1 << 18
#: Links whose counts are looked up at a time; a document with more is handled alone.
CHUNK_LINKS = 1 << 18
#: Words that each side keeps the ids of, and their bytes.
WORDS, WORD_BYTES = 150_000, 16 << 20


def _byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters are their own byte, the others follow from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the numbers of the pairs that can be linked."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = token_files.ByteLevelTable(a_path, plain=True), sentencepiece_codec.PieceTable(b_path)
        self.a.words, self.b.words = (ragged.WordIds(WORDS, WORD_BYTES) for _ in "ab")
        of = _byte_of_character()
        tokens = [self.a.tokenizer.id_to_token(i) or "" for i in range(self.a.tokenizer.get_vocab_size())]
        self.a_bytes = [bytes(of[c] for c in t) if all(c in of for c in t) else b"" for t in tokens]
        ends = self.b.shown_at + self.b.shown_len
        raw = self.b.shown.tobytes()
        self.b_bytes = [raw[i:j] for i, j in zip(self.b.shown_at.tolist(), ends.tolist(), strict=True)]
        self.a_flat = np.frombuffer(b"".join(self.a_bytes), np.uint8)
        self.a_len = np.array([len(t) for t in self.a_bytes], np.int64)
        self.a_at = np.cumsum(self.a_len) - self.a_len
        self.b_len = self.b.shown_len
        #: Pair numbers: a token of a with each length of its suffixes, then one of b with each shorter length.
        self.a_pairs, self.b_pairs = np.cumsum(self.a_len) - self.a_len - 1, self.a_len.sum() + np.cumsum(self.b_len) - self.b_len - 1
        self.n_pairs = int(self.a_len.sum() + self.b_len.sum())
        self.digits = np.zeros((max(len(self.a_len), len(self.b_len)), 6), np.uint8)
        for i in range(len(self.digits)):
            said = str(i).encode()
            self.digits[i, 5 - len(said) :] = np.frombuffer(said + b",", np.uint8)
        self.said_len = (self.digits != 0).sum(axis=1)
        if len(self.digits) > 100_000:
            raise ValueError("ids of more than five digits")

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair of tokens that end together."""
        return np.where(self.b_len[b] <= self.a_len[a], self.a_pairs[a] + self.b_len[b], self.b_pairs[b] + self.a_len[a])

    def b_of_pairs(self) -> np.ndarray:
        """The id of b in each pair; -1 for numbers that no pair has."""
        out = np.full(self.n_pairs, -1, np.int64)
        # A byte piece stands only for a byte that no piece of its own has, so pieces of text come last and stay.
        known = {t: i for i, t in sorted(enumerate(self.b_bytes), key=lambda x: not self.b.is_byte[x[0]]) if t}
        for a, token in enumerate(self.a_bytes):
            for k in range(1, len(token) + 1):
                if (b := known.get(token[-k:])) is not None:
                    out[self.a_pairs[a] + k] = b
        for b, size in enumerate(self.b_len.tolist()):
            out[self.b_pairs[b] + 1 : self.b_pairs[b] + size] = b
        return out

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of space and text of each row and their offsets; flat ids and sizes of both sides."""
        rows = [b" " + t.encode() if t else b"" for t in texts]
        data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        with_end, sizes = token_files.encode_rows(self.a, data, offsets, 0)
        keep = np.ones(len(with_end), bool)
        keep[np.cumsum(sizes) - 1] = False
        store, words, first = sentencepiece_codec.encode_texts(self.b, texts)
        b, upto = store.ids_of(words)
        return data, offsets, with_end[keep].astype(np.int64), sizes - 1, b.astype(np.int64), upto[first[1:]] - upto[first[:-1]]

    @staticmethod
    def same_text(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which rows' tokens give the rows' bytes again."""
        upto = np.concatenate([[0], np.cumsum(length[ids])])
        ends = np.cumsum(sizes)
        same = upto[ends] - upto[ends - sizes] == np.diff(offsets)
        if same.all() and len(data) == upto[-1]:
            other = np.flatnonzero(flat[ragged.ragged_index(at[ids], length[ids])] != data)
            same[np.searchsorted(offsets, other, "right") - 1] = False
            return same
        token = np.repeat(same, sizes)
        kept = data[np.repeat(same, np.diff(offsets))]
        other = np.flatnonzero(flat[ragged.ragged_index(at[ids[token]], length[ids[token]])] != kept)
        rows = np.flatnonzero(same)
        same[rows[np.searchsorted(np.cumsum(np.diff(offsets)[rows]), other, "right")]] = False
        return same

    def aligned(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Sizes of both sides, groups and links of each row, the links' pair numbers, and each row's groups as text hashed."""
        data, offsets, a, n_a, b, n_b = self.encoded(texts)
        good = self.same_text(data, offsets, a, n_a, self.a_flat, self.a_at, self.a_len) & self.same_text(data, offsets, b, n_b, self.b.shown, self.b.shown_at, self.b.shown_len)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        sizes = np.diff(offsets) * good
        # Ends counted over the whole batch: rows follow one another, and each row's last end is common.
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        index_a, index_b = np.full(int(sizes.sum()) + 1, -1, np.int64), np.full(int(sizes.sum()) + 1, -1, np.int64)
        index_a[end_a], index_b[end_b] = np.arange(len(a)), np.arange(len(b))
        common = np.flatnonzero((index_a >= 0) & (index_b >= 0))
        last_a, last_b = index_a[common], index_b[common]
        n_groups = np.diff(np.searchsorted(common, np.concatenate([[0], np.cumsum(sizes)]), "right"))
        return n_a, n_b, n_groups, n_groups, self.numbers(a[last_a], b[last_b]), self._digests(a, b, last_a, last_b, n_a + n_b)

    def _digests(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, sizes: np.ndarray) -> list[str]:
        """SHA-256 of each row's ``a1,a2|b1;a3|b2,b3``; empty for rows without tokens."""
        # A group's tokens of a stand behind all earlier groups' tokens of b, its tokens of b behind its tokens of a.
        at_a = np.arange(len(a)) + np.repeat(np.concatenate([[0], last_b[:-1] + 1]), np.diff(last_a, prepend=-1)) if len(a) else last_a
        at_b = np.arange(len(b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
        ids = np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        said, wide = self.digits[ids], self.said_len[ids]
        said[at_a[last_a], 5], said[at_b[last_b], 5] = ord("|"), ord(";")
        ends = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        raw = memoryview(said[said != 0].tobytes())
        return [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, groups_sha256 and pairs (the number of each link's pair) of each of the ``docs``."""
    schema = T.StructType([docs.schema[key], *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")), T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.IntegerType()))])

    def run(batches):
        both = aligner(a_path, b_path)
        for batch in batches:
            for i, j in ragged.row_slices(ragged.text_bytes(batch.column(1))[1], CHUNK_BYTES):
                *counts, pairs, said = both.aligned([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts[3])]), pa.int32()), pa.array(pairs.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(said, pa.string()), lists], schema.names)

    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, schema)


def _link_slices(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of some rows after another, and where each row's begin and end among them."""
    pairs, offsets = np.asarray(lists.values), np.asarray(lists.offsets).astype(np.int64)
    for i, j in ragged.row_slices(offsets, CHUNK_LINKS):
        yield pairs[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def pair_counts(links: DataFrame, n_pairs: int) -> np.ndarray:
    """How often each pair is linked in all :func:`aligned` documents; a task sends each pair once."""

    def run(batches):
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for pairs, _ in _link_slices(batch.column(0)):
                total += np.bincount(pairs, minlength=n_pairs)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["pair", "n"])

    out = np.zeros(n_pairs, np.int64)
    sums = links.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for pair, n in sums.toLocalIterator():  # n_pairs rows at most: the vocabularies bound them
        out[pair] = n
    return out


def counted(links: DataFrame, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """:func:`aligned` documents with n_best and count_sum in place of their pairs."""
    kept = [c for c in links.columns if c != "pairs"]
    schema = T.StructType([*links.select(*kept).schema, *(T.StructField(n, T.LongType()) for n in ("n_best", "count_sum"))])

    def run(batches):
        for batch in batches:
            sums = [(np.zeros(0, np.int64),) * 2]
            for pairs, ends in _link_slices(batch.column(len(kept))):
                upto = [np.concatenate([[0], np.cumsum(x[pairs], dtype=np.int64)]) for x in (best, counts)]
                sums.append(tuple(np.diff(s[ends]) for s in upto))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.concatenate(x)) for x in zip(*sums, strict=True))], schema.names)

    return links.select(*kept, "pairs").mapInArrow(run, schema)


def alignment_report(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each of the ``docs``.

    a is a byte-level BPE of the tokenizers library over space and text, b a
    SentencePiece model over the text, both without special tokens. A link is a
    token of a and one of b whose bytes end at the same offset; every group ends
    with one, so n_links equals n_groups where no token is without bytes. A null or
    empty text, and one whose tokens' bytes aren't those of space and text (one with
    U+2581 in it), has no tokens: zeros and an empty digest. One row for each input
    row; rows with one key, or none, are documents of their own. Other columns aren't read.
    """
    links = shared.written(aligned(docs, a_path, b_path, key, text), "links", compression="zstd")
    both = aligner(a_path, b_path)
    counts, of = pair_counts(links, both.n_pairs), both.b_of_pairs()
    most = np.zeros(len(both.b_len), np.int64)
    np.maximum.at(most, of[of >= 0], counts[of >= 0])
    best = (of >= 0) & (counts == most[of])
    return counted(links, counts, best).select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
