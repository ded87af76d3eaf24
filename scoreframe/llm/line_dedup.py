"""Repeated lines across documents, found by sharded minimal perfect hashes.

1. Chunks of documents turn into lines' hashes, written once: a 64-bit key and an
   independent 64-bit fingerprint for each line.
2. Each chunk sends every distinct line once, with its smallest and largest
   document, to the key's shard. A line in a third of all documents so costs one
   entry a chunk.
3. A shard builds a minimal perfect hash over its distinct lines of two documents
   or more. It indexes arrays of fingerprints, counts and first documents. All lines
   of the chunks probe these arrays: the fingerprint turns away those that only
   one document has, and the others come back.
4. Chunks turn the answers into lines to drop for each document, and documents
   that lose lines are cut. No line is joined with another line.

The number of shards follows the number of lines, so a shard stays small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm import ragged, shared

#: Bytes of text read at a time, and lines of a chunk, about.
CHUNK_BYTES, CHUNK_LINES = 2 << 20, 250_000
#: Lines that a shard is asked for, on average.
SHARD_KEYS = 250_000
LEAST_CHARS = 10
#: Stands for a missing document id: it comes after all others.
NO_ID = (1 << 63) - 1
_LEVEL_SEED = 0x9E3779B97F4A7C15
_MARK_SEED = 0x6A09E667F3BCC909


class MinimalPerfectHash:
    """Levels of bit arrays: a key, of two words, stands at the first level where no other key meets it."""

    def __init__(self, keys: np.ndarray, marks: np.ndarray, room: float = 1.6):
        self.size, self.levels, base, level = len(keys), [], 0, 0
        while len(keys):
            bits = max(1, int(len(keys) * room))
            at = self._place(keys, marks, level, bits)
            alone = np.bincount(at, minlength=bits) == 1
            self.levels.append((alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            rest = ~alone[at]
            keys, marks, level = keys[rest], marks[rest], level + 1

    @staticmethod
    def _place(keys: np.ndarray, marks: np.ndarray, level: int, bits: int) -> np.ndarray:
        seed = np.uint64(_LEVEL_SEED * (level + 1) % (1 << 64))
        return (ragged.mix(ragged.mix(keys + seed) + marks) % np.uint64(bits)).astype(np.int64)

    def slots(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The slot of each key; any slot, or -1, for keys that weren't given."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(keys[todo], marks[todo], level, len(alone))
            here = alone[at]
            out[todo[here]] = rank[at[here]]
            todo = todo[~here]
        return out


class LineIndex:
    """Fingerprint, count and first document of each line that two documents or more of a shard have."""

    def __init__(self, keys: np.ndarray, marks: np.ndarray, first: np.ndarray, last: np.ndarray, holders: np.ndarray):
        order = np.lexsort((marks, keys))
        keys, marks, first, last, holders = (x[order] for x in (keys, marks, first, last, holders))
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])
        start = np.flatnonzero(new)
        if len(start):
            first, last, holders = np.minimum.reduceat(first, start), np.maximum.reduceat(last, start), np.add.reduceat(holders, start)
        repeated = first != last
        keys, marks = keys[start][repeated], marks[start][repeated]
        self.hash = MinimalPerfectHash(keys, marks)
        slots, n = self.hash.slots(keys, marks), len(keys)
        self.fingerprint, self.count, self.first = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.fingerprint[slots], self.count[slots], self.first[slots] = marks, holders[repeated], first[repeated]

    def probe(self, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether two documents or more hold each line, and the first of them."""
        slots = self.hash.slots(keys, marks)
        found = slots >= 0
        found[found] = self.fingerprint[slots[found]] == marks[found]
        first = np.zeros(len(keys), np.int64)
        first[found] = self.first[slots[found]]
        return found, first


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and each row's first line, and one more. An empty row has one line."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    before = np.searchsorted(breaks, offsets[:-1])
    first = np.concatenate([before + np.arange(len(offsets) - 1), [len(starts)]])
    ends = np.concatenate([starts[1:] - 1, [len(data)]]) if len(starts) else starts
    ends[first[1:] - 1] = offsets[1:]
    return starts, ends, first


def line_keys(data: np.ndarray, offsets: np.ndarray, least_chars: int = LEAST_CHARS) -> tuple[np.ndarray, ...]:
    """Start, end, key, fingerprint and length test of every line, and each row's first line.

    What is hashed is the line without white space at its ends and with A-Z lower-cased.
    """
    starts, ends, first = line_spans(data, offsets)
    solid = np.flatnonzero(~ragged.WHITE_SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    s, e = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    s[some], e[some] = solid[a[some]], solid[b[some] - 1] + 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    enough = (chars[e] - chars[s]) >= least_chars
    keys, marks, lower = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64), ragged.LOWER_ASCII[data]
    keys[enough] = ragged.span_hashes(lower, s[enough], e[enough])
    marks[enough] = ragged.span_hashes(lower, s[enough], e[enough], _MARK_SEED)
    return starts, ends, keys, marks, enough, first


def _distinct(row: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct lines of each row."""
    order = np.lexsort((marks, keys, row))
    row, keys, marks = row[order], keys[order], marks[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])
    return row[new], keys[new], marks[new]


_LINES = {"chunk": "long", "n_keys": "long", "ids": "binary", "tags": "binary", "rows": "binary", "keys": "binary", "marks": "binary"}


def _line_table(docs: DataFrame, least_chars: int) -> DataFrame:
    """Of ``docs`` (id, tag, text), a row a chunk: its documents' ids and tags, and the distinct lines of each document."""

    def run(batches):
        number, held, n_docs, n_lines = TaskContext.get().partitionId() << 32, [], 0, 0

        def row() -> pa.RecordBatch:
            ids, tags, rows, keys, marks = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(keys)]), *(ragged.binary_column([x]) for x in (ids, tags, rows, keys, marks))], list(_LINES))

        for batch in batches:
            _, offsets = ragged.text_bytes(batch.column(2))
            ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, j in ragged.row_slices(offsets, CHUNK_BYTES):
                _, _, keys, marks, enough, first = line_keys(*ragged.text_bytes(batch.column(2).slice(i, j - i)), least_chars)
                rows, keys, marks = _distinct(np.repeat(np.arange(j - i), np.diff(first))[enough], keys[enough], marks[enough])
                held.append((ids[i:j], tags[i:j], (rows + n_docs).astype(np.uint32), keys, marks))
                n_docs, n_lines = n_docs + j - i, n_lines + len(keys)
                if n_lines + n_docs >= CHUNK_LINES:
                    yield row()
                    number, held, n_docs, n_lines = number + 1, [], 0, 0
        if held:
            yield row()

    return docs.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _LINES.items()))


def _requests(lines: DataFrame, shards: int) -> DataFrame:
    """A row for each chunk and shard: distinct lines with their smallest and largest document and how many hold them."""
    names = ["shard", "chunk", "keys", "marks", "low", "high", "held"]

    def run(batches):
        for batch in batches:
            for chunk, ids, rows, keys, marks in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                docs = np.frombuffer(ids, np.int64)[np.frombuffer(rows, np.uint32)]
                keys, marks = np.frombuffer(keys, np.uint64), np.frombuffer(marks, np.uint64)
                shard = ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((docs, marks, keys, shard))
                docs, keys, marks, shard = docs[order], keys[order], marks[order], shard[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])
                start = np.flatnonzero(new)
                stop = np.append(start[1:], len(keys)) if len(start) else start
                columns, shard = [keys[start], marks[start], docs[start], docs[stop - 1], (stop - start).astype(np.uint32)], shard[start]
                parts = ragged.runs(shard)
                yield pa.RecordBatch.from_arrays([pa.array(shard[[a for a, _ in parts]], pa.int64()), pa.array(np.full(len(parts), chunk, np.int64)), *(ragged.binary_column([x[a:b] for a, b in parts]) for x in columns)], names)

    return lines.select("chunk", "ids", "rows", "keys", "marks").mapInArrow(run, "shard long, chunk long, keys binary, marks binary, low binary, high binary, held binary")


def _all(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, list[np.ndarray]]:
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts or [np.zeros(0, kind)]), parts


def _answer(table: pa.Table) -> pa.Table:
    (keys, asked), (marks, marked) = (_all(table[c], np.uint64) for c in ("keys", "marks"))
    low, high, held = (_all(table[c], kind)[0] for c, kind in (("low", np.int64), ("high", np.int64), ("held", np.uint32)))
    index = LineIndex(keys, marks, low, high, held)
    out = [(chunk, k[twice], m[twice], first[twice]) for chunk, k, m in zip(table["chunk"].to_pylist(), asked, marked, strict=True) for twice, first in [index.probe(k, m)] if twice.any()]
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), **{name: ragged.binary_column([x[i] for x in out]) for i, name in ((1, "keys"), (2, "marks"), (3, "first"))}})


def _drops(lines: pa.Table, answers: pa.Table) -> pa.Table:
    (said, _), (said_marks, _), (first, _) = (_all(answers[c], kind) for c, kind in (("keys", np.uint64), ("marks", np.uint64), ("first", np.int64)))
    order = np.lexsort((said_marks, said))
    said, said_marks, first = said[order], said_marks[order], first[order]
    out = []
    for row in lines.to_pylist() if len(said) else []:
        ids, tags, rows, keys, marks = (np.frombuffer(row[c], kind) for c, kind in (("ids", np.int64), ("tags", np.int64), ("rows", np.uint32), ("keys", np.uint64), ("marks", np.uint64)))
        # Each line of the chunk in the order of the answers; equal keys of different marks are told apart by their place.
        whole = np.concatenate([said, keys]), np.concatenate([said_marks, marks]), np.repeat([0, 1], [len(said), len(keys)])
        order = np.lexsort((whole[2], whole[1], whole[0]))
        answer = np.maximum.accumulate(np.where(whole[2][order] == 0, order, -1))
        at = np.empty(len(order), np.int64)
        at[order] = answer
        at = at[len(said) :]
        docs, has = ids[rows], at >= 0
        at = np.maximum(at, 0)
        gone = has & (said[at] == keys) & (said_marks[at] == marks) & (first[at] != docs)
        rows, both = rows[gone], np.stack([keys[gone], marks[gone]], axis=1)
        out += [(int(ids[rows[a]]), int(tags[rows[a]]), both[a:b].tobytes()) for a, b in ragged.runs(rows)]
    return pa.table({"id": pa.array([x[0] for x in out], pa.int64()), "tag": pa.array([x[1] for x in out], pa.int64()), "dropped": pa.array([x[2] for x in out], pa.binary())})


def _ids(key: str, text: str) -> tuple:
    """A document's id, and what tells rows without a key apart: they are all last, but mustn't meet in one task."""
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), F.when(F.col(key).isNull(), F.coalesce(F.xxhash64(text), F.lit(0))).otherwise(0).cast("long")


def lines_to_drop(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """A row (id, tag, dropped) for each row of ``docs`` that loses a line; equal ids may repeat. ``dropped`` has a key and a fingerprint for each line."""
    i, tag = _ids(key, text)
    lines = shared.written(_line_table(docs.select(i.alias("id"), tag.alias("tag"), F.col(text).alias("text")), least_chars), "lines")
    total = lines.agg(F.sum("n_keys")).first()[0] or 0
    requests = _requests(lines, max(1, -(-total // SHARD_KEYS)))
    answers = requests.groupBy("shard").applyInArrow(_answer, "chunk long, keys binary, marks binary, first binary")
    found = lines.drop("n_keys").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_drops, "id long, tag long, dropped binary")
    out = shared.written(found, "line-drops")
    shared.discard(lines)
    return out


def cut_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``docs`` without repeated lines in ``text``, and nothing else changed; counts of lines go to new columns of the given names."""
    i, tag = _ids(key, text)
    drops = lines_to_drop(docs, key, text, least_chars).groupBy(F.col("id").alias("__sf_drop_id"), F.col("tag").alias("__sf_drop_tag")).agg(F.collect_set("dropped").alias("__sf_drops"))
    named = docs.withColumns({"__sf_id": i, "__sf_tag": tag})
    joined = named.join(drops, (F.col("__sf_id") == F.col("__sf_drop_id")) & (F.col("__sf_tag") == F.col("__sf_drop_tag")), "left").select(*docs.columns, "__sf_drops")
    extra = [n for n in (n_lines, n_dropped) if n]
    schema, names = docs.select("*", *(F.lit(0).cast("long").alias(n) for n in extra)).schema, docs.columns
    schema_names = schema.names

    def run(batches):
        for batch in batches:
            where, texts = names.index(text), batch.column(names.index(text))
            whole = pc.fill_null(texts, "")
            counts = {n_lines: pc.add(pc.count_substring(whole, "\n"), 1).cast(pa.int64()), n_dropped: np.zeros(len(batch), np.int64)}
            drops = batch.column(len(names))
            changed = np.flatnonzero(np.asarray(drops.is_valid()))
            if len(changed):
                new, held = texts.to_pylist(), whole.take(pa.array(changed))
                for i, j in ragged.row_slices(ragged.text_bytes(held)[1], CHUNK_BYTES):
                    data, at = ragged.text_bytes(held.slice(i, j - i))
                    starts, ends, keys, marks, enough, first = line_keys(data, at, least_chars)
                    raw, both = data.tobytes(), list(zip(keys.tolist(), marks.tolist(), strict=True))
                    for k, parts in enumerate(drops.take(pa.array(changed[i:j])).to_pylist()):
                        gone = {tuple(pair) for part in parts for pair in np.frombuffer(part, np.uint64).reshape(-1, 2).tolist()}
                        kept = [raw[starts[x] : ends[x]] for x in range(first[k], first[k + 1]) if not (enough[x] and both[x] in gone)]
                        lost = first[k + 1] - first[k] - len(kept)
                        if lost:
                            new[changed[i + k]] = b"\n".join(kept).decode()
                            counts[n_dropped][changed[i + k]] = lost
                texts = pa.array(new, texts.type)
            columns = [texts if i == where else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[n]) if n == n_dropped else counts[n] for n in extra)], schema_names)

    return joined.mapInArrow(run, schema)


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` without the lines that an earlier document has, and with n_lines and n_dropped.

    A text is split at each newline; null or empty texts have one empty line. A
    line's key of ``least_chars`` code points or more, found in at least two
    documents, loses all its lines except in the smallest id that holds it.
    Kept lines are joined by newlines; a text that loses all is empty. Rows with
    one id are one document. Ids are whole numbers (others end in Spark's cast
    error). Rows without an id come after all others and are one document; the
    largest long counts as such. A null text stays null. All other columns stay;
    columns named n_lines or n_dropped are replaced. No row is lost.
    """
    return cut_documents(docs.drop("n_lines", "n_dropped"), key, text, least_chars, "n_lines", "n_dropped")
