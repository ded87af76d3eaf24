"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts becomes one flat array of symbols. Texts are cut where no piece
of the model can reach across, so equal words are encoded once a batch. In each
round every word takes its smallest pair rank (a segmented minimum), merges all
leftmost, non-overlapping pairs of that rank at once, and the arrays are
compacted; the rounds end when no word has a pair left.

A merge is simultaneous only where that equals the library's order (best score
first, then leftmost): if the merged piece is part of a piece of the same or a
better rank, its word merges only the leftmost pair in that round. Words are also
cut between characters that stand side by side in no piece, so Chinese or base64
falls into short runs. What still has more than ``LONG_WORD`` symbols (such as one
letter thousands of times) takes the same order from a heap, since rounds over one
long run would take quadratic time.

Only models with the identity normaliser, a dummy prefix and kept white space
are taken; others are refused with ValueError.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm import ragged

#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK_BYTES = 2 << 20
LONG_WORD = 2048
_NONE = np.iinfo(np.int32).max
_MARK = "▁"


class PieceTable:
    """What encoding and decoding need of a model, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ ½  x ") != "▁ﬁ▁½▁▁x▁":
            raise ValueError("only identity normalisation with a dummy prefix and kept white space is supported")
        self.size = n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        normal = {p: i for i, p in enumerate(pieces) if i not in special}
        if any(_MARK in p.lstrip(_MARK) for p in normal):
            raise ValueError("a piece has a word boundary inside it")
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self.end_id = model.eos_id()
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)

        self.first = np.full(0x110000, -1, np.int32)
        self.point = np.full(max(symbols.values()) + 1, -1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.first[ord(s)] = i
                self.point[i] = ord(s)
        scores = np.array([model.get_score(i) for i in range(n)], np.float32)
        rank = np.unique(-scores, return_inverse=True)[1]
        left, right, into = [], [], []
        self.unsafe = np.zeros(len(self.point), bool)
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), into.append(i)
                    for part in (a, b):
                        if part < n and rank[i] <= rank[part]:
                            self.unsafe[part] = True
        self._hash_pairs(np.array(left, np.uint64), np.array(right, np.uint64), np.array(into, np.int32), rank)
        #: Pairs of characters that stand side by side in some piece.
        beside = {(symbols[p[k]] << 32) | symbols[p[k + 1]] for p in normal for k in range(len(p) - 1)}
        self.beside = np.array(sorted(beside), np.int64)
        #: Bytes that stand in no piece of several characters: words are cut on both sides of them.
        inside = {b for p in normal if len(p) > 1 for b in p.encode()}
        self.alone = np.array([b not in inside and b < 128 and b != 0x20 for b in range(256)])

        shown = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else p.replace(_MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_len = np.array([len(s) for s in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len
        self.is_byte = np.array([model.is_byte(i) for i in range(n)])
        self.starts_word = np.array([p.startswith(_MARK) and i not in special for i, p in enumerate(pieces)])
        self.silent = self.shown_len == 0
        self.words = ragged.WordIds(say=True)

    def _hash_pairs(self, left, right, into, rank) -> None:
        """An open-addressed table from a pair of symbols to the rank and the merged piece."""
        keys = (left << np.uint64(32)) | right
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.table = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.table_rank = np.full(1 << self.bits, _NONE, np.int32)
        self.table_into = np.zeros(1 << self.bits, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.table[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            took = todo[free]
            took = took[np.unique(slot[took], return_index=True)[1]]
            self.table[slot[took]], self.table_rank[slot[took]], self.table_into[slot[took]] = keys[took], rank[into[took]], into[took]
            todo = np.setdiff1d(todo, took, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (none: the largest int32) and the piece it makes."""
        rank, into = np.full(len(left), _NONE, np.int32), np.zeros(len(left), np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[todo].astype(np.uint64) << np.uint64(32)) | right[todo].astype(np.uint64)
        slot = self._slot(keys)
        for _ in range(self.probes):
            found = self.table[slot]
            same = found == keys
            rank[todo[same]], into[todo[same]] = self.table_rank[slot[same]], self.table_into[slot[same]]
            more = ~same & (found != np.uint64(0xFFFFFFFFFFFFFFFF))
            if not more.any():
                break
            todo, keys, slot = todo[more], keys[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return rank, into


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code point and byte position of each character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int64)
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    point = np.where(size == 1, lead, lead & (0xFF >> (size + 1)))
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for k in (1, 2, 3):
        point = np.where(size > k, (point << 6) | (padded[at + k] & 0x3F), point)
    return point, at


def _merge_heap(table: PieceTable, symbols: np.ndarray) -> np.ndarray:
    """One long word: best rank first, then leftmost, from a heap."""
    sym, n = symbols.tolist(), len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    rank, into = (x.tolist() for x in table.pairs(symbols[:-1], symbols[1:]))
    heap = [(r, i, i + 1, p) for i, (r, p) in enumerate(zip(rank, into, strict=True)) if r != _NONE]
    made = {(i, i + 1): (sym[i], sym[i + 1]) for _, i, _, _ in heap}
    heapq.heapify(heap)
    dead, memo = bytearray(n), {}

    def push(i: int, j: int) -> None:
        if i < 0 or j < 0:
            return
        pair = (sym[i], sym[j])
        if pair not in memo:
            memo[pair] = tuple(int(x[0]) for x in table.pairs(np.array(pair[:1]), np.array(pair[1:])))
        r, p = memo[pair]
        if r != _NONE:
            made[i, j] = pair
            heapq.heappush(heap, (r, i, j, p))

    while heap:
        _, i, j, piece = heapq.heappop(heap)
        if dead[i] or dead[j] or after[i] != j or made.get((i, j)) != (sym[i], sym[j]):
            continue
        sym[i], dead[j], after[i] = piece, 1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(before[i], i)
        push(i, after[i])
    return np.array([s for s, d in zip(sym, dead, strict=True) if not d], np.int64)


def merge_rounds(table: PieceTable, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols and their words; ``word`` ascends, a number for each symbol."""
    done_sym, done_word = [], []
    sizes = np.bincount(word) if len(word) else np.zeros(0, np.int64)
    if len(sizes) and sizes.max() > LONG_WORD:
        long = sizes[word] > LONG_WORD
        for w in np.flatnonzero(sizes > LONG_WORD):
            merged = _merge_heap(table, sym[word == w])
            done_sym.append(merged), done_word.append(np.full(len(merged), w))
        sym, word = sym[~long], word[~long]
    rank, into = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
    if len(sym) > 1:
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], into[inner] = table.pairs(sym[inner], sym[inner + 1])
    while len(sym):
        starts = ragged.run_starts(word)
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(starts, append=len(word))
        least = np.repeat(least, sizes)
        live = least != _NONE
        if not live.all():
            done_sym.append(sym[~live]), done_word.append(word[~live])
            sym, word, rank, into, least = sym[live], word[live], rank[live], into[live], least[live]
            if not len(sym):
                break
        at = np.flatnonzero(rank == least)
        if (risky := table.unsafe[into[at]]).any():
            firsts = np.zeros(len(at), bool)
            firsts[ragged.run_starts(word[at])] = True
            slow = np.zeros(word[-1] + 1, bool)
            slow[word[at[risky]]] = True
            at = at[firsts | ~slow[word[at]]]
        runs = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
        offset = np.arange(len(at)) - np.repeat(runs, np.diff(runs, append=len(at)))
        at = at[offset % 2 == 0]
        sym[at] = into[at]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        sym, word, rank, into = sym[stay], word[stay], rank[stay], into[stay]
        at = at - np.arange(len(at))
        touched = np.zeros(len(sym) + 1, bool)
        touched[at] = touched[at - 1] = True
        near = np.flatnonzero(touched[:-1])
        rank[near] = _NONE
        near = near[near + 1 < len(sym)]
        near = near[word[near] == word[near + 1]]
        rank[near], into[near] = table.pairs(sym[near], sym[near + 1])
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], word[order]


def encode_spans(table: PieceTable, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every span, one after another, and how many each span has."""
    sizes = ends - starts
    data = data[ragged.ragged_index(starts, sizes)]
    point, at = code_points(data)
    word = np.searchsorted(np.cumsum(sizes), at, "right")
    sym = table.first[np.where(point == 0x20, 0x2581, point)].astype(np.int64)
    sym = np.where(sym >= 0, sym, -point - 1)
    # A run is a part of a word that no piece reaches out of.
    opens = np.ones(len(sym), bool)
    key = (sym[:-1] << 32) | sym[1:]
    at = np.minimum(np.searchsorted(table.beside, key), len(table.beside) - 1)
    opens[1:] = (word[1:] != word[:-1]) | (table.beside[at] != key) | (sym[:-1] < 0) | (sym[1:] < 0)
    word_of = word[opens]
    sym, run = merge_rounds(table, sym, np.cumsum(opens) - 1)
    word = word_of[run]
    foreign = (sym < 0) | (sym >= table.size)
    counts = np.bincount(word, minlength=len(starts))
    if not foreign.any():
        return sym.astype(np.int32), counts
    outside = np.where(sym < 0, -sym - 1, table.point[np.maximum(sym, 0)])
    ids = [table.byte_id[np.frombuffer(chr(c).encode(), np.uint8)] if f else None for c, f in zip(outside[foreign], foreign[foreign], strict=True)]
    repeat = np.ones(len(sym), np.int64)
    repeat[foreign] = [len(x) for x in ids]
    out = np.repeat(sym, repeat)
    out[np.repeat(foreign, repeat)] = np.concatenate(ids)
    return out.astype(np.int32), np.bincount(np.repeat(word, repeat), minlength=len(starts))


def cut_words(table: PieceTable, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that cover all rows, cut where no piece can reach across; and the first span of each row."""
    begin = np.zeros(len(data) + 1, bool)
    space = data == 0x20
    alone = table.alone[data]
    begin[:-1] = alone | space
    begin[1:-1] &= ~(space[1:] & space[:-1])
    begin[1:] |= alone
    begin[offsets] = True
    cuts = np.flatnonzero(begin[: len(data)]) if len(data) else np.zeros(0, np.int64)
    return cuts, np.append(cuts[1:], len(data)) if len(cuts) else cuts, np.searchsorted(cuts, offsets)


def _one_each(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("scoreframe_each_byte", _one_each)


def decode_rows(table: PieceTable, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The UTF-8 text of each row of ids, as the library's decode() gives it."""
    raw = table.shown[ragged.ragged_index(table.shown_at[ids], table.shown_len[ids])].tobytes()
    ends = np.cumsum(counts)
    at = np.concatenate([[0], np.cumsum(table.shown_len[ids])])
    stop, start = at[ends], at[ends - counts]
    loud = np.flatnonzero(~table.silent[ids])
    k = np.searchsorted(loud, ends - counts)
    head = np.append(loud, len(ids))[k]
    has = head < ends
    opened = np.zeros(len(counts), bool)
    opened[has] = table.starts_word[ids[head[has]]]
    start = start + opened
    bytewise = np.concatenate([[0], np.cumsum(table.is_byte[ids])])
    risky = bytewise[ends] > bytewise[ends - counts]
    out = []
    for a, b, r in zip(start.tolist(), stop.tolist(), risky.tolist(), strict=True):
        text = raw[a:b]
        if r:
            text = text.decode("utf-8", "scoreframe_each_byte").encode()
        out.append(text)
    return out


def encode_texts(table: PieceTable, texts: list[str]) -> tuple[ragged.WordIds, np.ndarray, np.ndarray]:
    """The words met so far with their ids; every word of the texts as its number there; each text's first word, and one more."""
    rows = [(" " + t.replace(_MARK, " ")).encode() if t else b"" for t in texts]
    data = np.frombuffer(b"".join(rows), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    starts, ends, first = cut_words(table, data, offsets)
    return (store := table.words), store.numbers(data, starts, ends, lambda k: encode_spans(table, data, starts[k], ends[k])), first


def _batches(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    _, offsets = ragged.text_bytes(column)
    yield from ragged.row_slices(offsets, most)


def encode_batch(table: PieceTable, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts, each with the end id, and how many each text has."""
    store, words, first = encode_texts(table, texts)
    flat, upto = store.ids_of(words)
    sizes = upto[first[1:]] - upto[first[:-1]]
    out = np.full(len(flat) + len(texts), table.end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(sizes + 1) - 1] = False
    out[keep] = flat
    return out, sizes + 1


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text`` (end id last) in a new column ``ids``.

    A null or empty text has the end id only. Rows, order within a partition and
    all other columns stay; a column already named ``ids`` is replaced.
    """
    docs = docs.drop(ids) if ids in docs.columns else docs
    schema = docs.select("*", F.array().cast("array<int>").alias(ids)).schema

    def run(batches):
        table = piece_table(model_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for i, j in _batches(column, CHUNK_BYTES):
                flat, sizes = encode_batch(table, [t or "" for t in column.slice(i, j - i).to_pylist()])
                at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(at, pa.array(flat))], [*part.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the decoded text of ``ids`` in a new column ``text``; null ids give an empty text."""
    tokens = tokens.drop(text) if text in tokens.columns else tokens
    schema = tokens.select("*", F.lit("").alias(text)).schema

    def run(batches):
        table = piece_table(model_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
            said = decode_rows(table, np.asarray(pc.list_flatten(column)).astype(np.int64), sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.decode() for s in said], pa.string())], [*batch.schema.names, text])

    return tokens.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's number of ids and the digests of its ids and of what they decode to.

    The ids are joined in decimal by one space. Null texts count as empty. One row
    for each input row, repeated ones included; other columns are not read.
    """
    source = docs.select(F.col(key), F.col(text).alias("__text"))
    schema = docs.select(F.col(key), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches):
        table = piece_table(model_path)
        for batch in batches:
            for i, j in _batches(batch.column(1), CHUNK_BYTES):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                store, words, first = encode_texts(table, texts)
                said, end = store.said, b"%d" % table.end_id
                digests, bounds, order = [], first.tolist(), words.tolist()
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    digests.append(hashlib.sha256(b" ".join([said[w] for w in order[a:b]] + [end])).hexdigest())
                flat, upto = store.ids_of(words)
                sizes = upto[first[1:]] - upto[first[:-1]]
                decoded = decode_rows(table, flat, sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes + 1, pa.int64()), pa.array(digests), pa.array([hashlib.sha256(d).hexdigest() for d in decoded])],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return source.mapInArrow(run, schema)
