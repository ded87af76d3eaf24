"""Numpy helpers over flat byte buffers: rows, spans, hashes and ragged gathers.

A column of texts is one byte array with row offsets; a span is a pair of byte
positions. Everything here works on whole arrays; only :class:`WordIds` holds state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer spans are hashed, and compared, in pieces of so many bytes.
PIECE_BYTES = 512
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first 0 .. 8 bytes of a block.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: The white space of the contracts, 0x20 and 0x09 to 0x0D.
WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that aren't white space."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~WHITE_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = np.asarray(h, np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end."""
    return _blocks(np.concatenate([data, np.zeros(8, np.uint8)]))


def _blocks(padded: np.ndarray) -> np.ndarray:
    return np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded.data, 0, (1,))


def _chained(block: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Each span's blocks mixed in one after another."""
    out = np.empty(len(starts), np.uint64)
    live, at, left = np.arange(len(starts)), starts, sizes
    h = mix(sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
    while len(live):
        h = mix(h ^ (block[at] & _LOW[np.minimum(left, 8)])) + GOLD
        out[live] = h
        more = left > 8
        live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    return out


def _pieces(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the pieces of all spans, each piece's place in its span, and each span's first piece."""
    n = np.maximum(-(-sizes // PIECE_BYTES), 1)
    nth = ragged_index(np.zeros(len(n), np.int64), n)
    at = np.repeat(starts, n) + nth * PIECE_BYTES
    return at, np.minimum(np.repeat(starts + sizes, n) - at, PIECE_BYTES), nth, np.cumsum(n) - n


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span's bytes, wherever it stands. Hashes of different seeds are independent."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    block, sizes = blocks(data), ends - starts
    if sizes.max() <= PIECE_BYTES:
        return _chained(block, starts, sizes, seed)
    out, long = np.empty(len(starts), np.uint64), sizes > PIECE_BYTES
    out[~long] = _chained(block, starts[~long], sizes[~long], seed)
    at, size, nth, first = _pieces(starts[long], sizes[long])
    parts = mix(_chained(block, at, size, seed) + GOLD * (nth.astype(np.uint64) + np.uint64(1)))
    out[long] = mix(np.add.reduceat(parts, first) + sizes[long].astype(np.uint64))
    return out


def same_spans(block: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, at: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Whether each span of the one side has the same bytes as that of the other; sides are given by :func:`blocks`."""
    same = sizes == other_sizes
    if len(sizes) and sizes.max() > PIECE_BYTES:
        long = np.flatnonzero(same & (sizes > PIECE_BYTES))
        short = np.flatnonzero(same & (sizes <= PIECE_BYTES))
        same[short] = same_spans(block, starts[short], sizes[short], other, at[short], sizes[short])
        if len(long):
            a, size, _, first = _pieces(starts[long], sizes[long])
            same[long] = np.logical_and.reduceat(same_spans(block, a, size, other, _pieces(at[long], sizes[long])[0], size), first)
        return same
    live = np.flatnonzero(same)
    a, b, left = starts[live], at[live], sizes[live]
    while len(live):
        alike = ((block[a] ^ other[b]) & _LOW[np.minimum(left, 8)]) == 0
        same[live[~alike]] = False
        more = alike & (left > 8)
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    return same


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one range after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def run_starts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """First position of each run of equal values, and the one after its last."""
    start = run_starts(values).tolist()
    return list(zip(start, [*start[1:], len(values)], strict=False))


def binary_column(parts: list) -> pa.Array:
    return pa.array([memoryview(np.ascontiguousarray(p)).tobytes() for p in parts], pa.binary())


class WordIds:
    """Token ids of the words met so far by one Python worker, found by an open-addressed table of hashes.

    It only saves work: a word left out is encoded again. A word found by its hash
    counts only if its bytes are the stored ones. Beyond ``most`` words or
    ``most_bytes`` bytes, those met in most batches stay, half of ``most`` at most,
    and the others go, so its memory is bounded.
    """

    def __init__(self, most: int = 200_000, most_bytes: int = 32 << 20, say: bool = False):
        self.most, self.most_bytes, self.say = most, most_bytes, say
        #: If asked for, each word's ids in decimal, joined by spaces.
        self.said: list[bytes] = []
        self._take(np.zeros(0, np.int64))

    def _take(self, words: np.ndarray) -> None:
        """Keeps these words alone, numbered anew."""
        if len(words):
            hashes, counts, sizes, met = self.hash[words], self.count[words], self.size[words], self.met[words]
            flat, raw = self.flat[ragged_index(self.at[words], counts)], self.raw[ragged_index(self.byte[words], sizes)]
        else:
            hashes, counts, sizes, met, flat, raw = np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.said = [self.said[w] for w in words.tolist()] if self.say else []
        self.bits = 16
        self.table, self.number = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.words = self.used = self.used_bytes = 0
        self.hash, self.at, self.count, self.byte, self.size = np.zeros(1 << 14, np.uint64), *(np.zeros(1 << 14, np.int64) for _ in range(4))
        self.met = np.zeros(1 << 14, np.int32)
        self.flat, self.raw = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint8)
        kept = self._add(hashes, flat, counts, raw, sizes, np.ones(len(hashes), bool))
        self.met[kept] = met // 2

    def _add(self, hashes: np.ndarray, flat: np.ndarray, counts: np.ndarray, raw: np.ndarray, sizes: np.ndarray, listed: np.ndarray) -> np.ndarray:
        n, first = len(hashes), self.words
        for name, needed in (("flat", self.used + len(flat)), ("raw", self.used_bytes + len(raw) + 8), *((c, first + n) for c in ("hash", "at", "count", "byte", "size", "met"))):
            setattr(self, name, self._room(getattr(self, name), needed))
        new = slice(first, first + n)
        self.flat[self.used : self.used + len(flat)], self.raw[self.used_bytes : self.used_bytes + len(raw)] = flat, raw
        self.at[new], self.byte[new] = self.used + np.cumsum(counts) - counts, self.used_bytes + np.cumsum(sizes) - sizes
        self.hash[new], self.count[new], self.size[new], self.met[new] = hashes, counts, sizes, 0
        self.used, self.used_bytes, self.words = self.used + len(flat), self.used_bytes + len(raw), first + n
        if 2 * self.words > len(self.table):
            old = np.flatnonzero(self.table)
            hashes_held, numbers_held = self.table[old], self.number[old]
            self.bits = int(4 * self.words).bit_length()
            self.table, self.number = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._list(hashes_held, numbers_held)
        new_words = np.flatnonzero(listed & (hashes != 0))
        self._list(hashes[new_words], first + new_words)
        return np.arange(first, first + n)

    def _list(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Puts distinct hashes into the table, each at the first free slot from its own on."""
        slot = self._slots(hashes)
        while len(hashes):
            free = np.flatnonzero(self.table[slot] == 0)
            took = free[np.unique(slot[free], return_index=True)[1]]
            self.table[slot[took]], self.number[slot[took]] = hashes[took], numbers[took]
            rest = np.ones(len(hashes), bool)
            rest[took] = False
            hashes, numbers, slot = hashes[rest], numbers[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the word of each hash; -1 if there is none."""
        found = np.full(len(hashes), -1, np.int64)
        todo, slot = np.arange(len(hashes)), self._slots(hashes)
        while len(todo):
            held = self.table[slot]
            here = (held == hashes[todo]) & (held != 0)
            found[todo[here]] = self.number[slot[here]]
            more = ~here & (held != 0)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return found

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> np.ndarray:
        """Each span's number. ``encode(indices)`` gives the flat ids and the counts of spans not met yet."""
        if self.words > self.most or self.used_bytes > self.most_bytes:
            kept = np.flatnonzero(self.met[: self.words])
            kept = kept[np.argsort(-self.met[kept], kind="stable")[: self.most // 2]]
            self._take(np.sort(kept[np.cumsum(self.size[kept]) <= self.most_bytes // 2]))
        hashes, sizes, block = span_hashes(data, starts, ends), ends - starts, blocks(data)
        found = self._find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            _, index, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            order = np.argsort(index)
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            found[new] = self._encoded(data, starts, sizes, hashes, new[index[order]], encode, True)[back[which]]
        old = np.ones(len(found), bool)
        old[new] = False
        self.met[found[old]] += 1
        other = np.flatnonzero(~same_spans(block, starts, sizes, _blocks(self.raw), self.byte[found], self.size[found]))
        if len(other):
            found[other] = self._encoded(data, starts, sizes, hashes, other, encode, False)
        return found

    def _encoded(self, data, starts, sizes, hashes, these: np.ndarray, encode, listed: bool) -> np.ndarray:
        flat, counts = encode(these)
        if self.say:
            numbers, ends = flat.tolist(), np.cumsum(counts)
            self.said += [" ".join(map(str, numbers[b - c : b])).encode() for b, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        return self._add(hashes[these], flat, counts, data[ragged_index(starts[these], sizes[these])], sizes[these], np.full(len(these), listed))

    @staticmethod
    def _room(array: np.ndarray, needed: int) -> np.ndarray:
        return array if needed <= len(array) else np.concatenate([array, np.zeros(max(needed, 2 * len(array)) - len(array), array.dtype)])

    def ids_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all the words, and where each word's ids begin, and one more."""
        counts = self.count[words]
        return self.flat[ragged_index(self.at[words], counts)], np.concatenate([[0], np.cumsum(counts)])
