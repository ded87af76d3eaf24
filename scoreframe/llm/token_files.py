"""Token ids of documents in Parquet list columns, in document order.

The files hold one row a document: ``doc_id``, ``part`` (number of the file),
``part_start`` (ids of that file before the row), ``n_tokens`` and ``ids``.
``ids`` is dictionary-encoded, the other columns are delta-encoded; row groups
and pages are bounded and have page indexes, so a reader can take the metadata
alone, or the ids of a range of documents.

Texts are cut before each run of white space, and between an ASCII letter or digit
and ASCII punctuation. The tokenizer's own pattern never joins what stands on both
sides of such a cut, so each distinct piece goes to the tokenizers library once
and its ids are gathered for every place it stands at.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.llm import ragged, shared

CHUNK_BYTES = 2 << 20
#: Distinct pieces given to the library in one text: each begins with white space, so they stay apart.
JOINED = 200
#: Bytes of text that a file holds the ids of, about.
FILE_TEXT_BYTES = 16 << 20
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Unicode white space outside ASCII.
WIDE_SPACES = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ALNUM, _PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class ByteLevelTable:
    """A tokenizers library's byte-level BPE and the pieces it has encoded; if ``plain``, special tokens' strings are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        kind = json.loads(self.tokenizer.to_str())
        split = kind.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or kind.get("normalizer"):
            raise ValueError("only byte-level tokenizers without normaliser and prefix space are supported")
        if any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in kind["added_tokens"]):
            raise ValueError("an added token reaches across white space")
        #: Bytes that each id stands for: the byte-level alphabet has a character for each byte.
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.whole = [] if plain else [t["content"].encode() for t in kind["added_tokens"]]
        for t in kind["added_tokens"]:
            self.bytes_of[t["id"]] = len(t["content"].encode())
        self.words = ragged.WordIds(most=400_000)

    def encode_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of some pieces and how many each has; ``space`` tells which bytes are white space."""
        # A piece from white space to something else stays apart from others of its kind when they are joined.
        tied = space[starts] & ~space[ends - 1]
        order = np.concatenate([np.flatnonzero(tied), np.flatnonzero(~tied)])
        sizes = (ends - starts)[order]
        stops = np.cumsum(sizes)
        many = int(tied.sum())
        edges = np.concatenate([np.arange(0, many, JOINED), np.arange(many, len(order) + 1)])
        at = np.concatenate([[0], stops])[edges].tolist()
        raw = data[ragged.ragged_index(starts[order], sizes)].tobytes()
        texts = [raw[a:b].decode() for a, b in zip(at, at[1:], strict=False)]
        encoded = (e for k in range(0, len(texts), 64) for e in self.tokenizer.encode_batch_fast(texts[k : k + 64], add_special_tokens=False))
        flat = np.concatenate([np.array(e.ids, np.int32) for e in encoded])
        # Every byte is in an id, so the ids' bytes say which piece they belong to.
        piece = np.searchsorted(stops, np.cumsum(self.bytes_of[flat]), "left")
        counts = np.bincount(piece, minlength=len(order))
        begin, back = np.cumsum(counts) - counts, np.argsort(order)
        return flat[ragged.ragged_index(begin[back], counts[back])], counts[back]


@lru_cache(maxsize=2)
def byte_level_table(path: str) -> ByteLevelTable:
    return ByteLevelTable(path)


_WIDE = np.sort(np.array([int.from_bytes(c.encode(), "little") for c in WIDE_SPACES], np.uint64))


def white_space(data: np.ndarray) -> np.ndarray:
    """Which bytes of valid UTF-8 belong to white space, that outside ASCII included."""
    space = ragged.WHITE_SPACE[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        size = np.where(data[lead] == 0xC2, 2, 3)
        code = ragged.blocks(data)[lead] & np.where(size == 2, np.uint64(0xFFFF), np.uint64(0xFFFFFF))
        wide = _WIDE[np.minimum(np.searchsorted(_WIDE, code), len(_WIDE) - 1)] == code
        space[ragged.ragged_index(lead[wide], size[wide])] = True
    return space


def cut_pieces(data: np.ndarray, offsets: np.ndarray, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans that cover all rows, the first span of each row, and which bytes are white space. Nothing is cut inside the strings of ``whole``."""
    space = white_space(data)
    begin = np.zeros(len(data) + 1, bool)
    begin[1:-1] = (space[1:] & ~space[:-1]) | (_PUNCTUATION[data[1:]] & _ALNUM[data[:-1]])
    raw = data.tobytes()
    for token in whole:
        at = raw.find(token)
        while at >= 0:
            begin[at + 1 : at + len(token)] = False
            at = raw.find(token, at + len(token))
    begin[offsets] = True
    cuts = np.flatnonzero(begin[: len(data)])
    return cuts, np.append(cuts[1:], len(data)) if len(cuts) else cuts, np.searchsorted(cuts, offsets), space


def encode_rows(table: ByteLevelTable, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all rows, each with the end id, and how many each row has."""
    starts, ends, first, space = cut_pieces(data, offsets, table.whole)
    words = table.words.numbers(data, starts, ends, lambda k: table.encode_spans(data, starts[k], ends[k], space))
    flat, upto = table.words.ids_of(words)
    sizes = upto[first[1:]] - upto[first[:-1]] + 1
    out = np.full(len(flat) + len(sizes), end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(sizes) - 1] = False
    out[keep] = flat
    return out, sizes


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Writes the token files of all ``docs`` under ``path``, in ascending order of ``key``.

    A null text counts as empty and has the end id only; rows without a key come
    first; rows with equal keys, or none, are all kept, in the order of a hash of
    their texts, and so are spread over files however many they are. The number of
    files follows the bytes of the texts. Columns other than the key and the text aren't read.
    """
    source = docs.select(F.col(key), F.col(text).alias("__text"))
    files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(source.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) // FILE_TEXT_BYTES))
    ranged = source.withColumns({"__hash": F.xxhash64("__text"), "__row": F.monotonically_increasing_id()})
    ordered = ranged.repartitionByRange(files, key, "__hash", "__row").sortWithinPartitions(key, "__hash", "__row").select(key, "__text")
    schema = T.StructType([docs.schema[key], *(T.StructField(n, T.LongType()) for n in ("part", "part_start", "n_tokens")), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        table, part, before = byte_level_table(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = ragged.text_bytes(batch.column(1))
            for i, j in ragged.row_slices(offsets, CHUNK_BYTES):
                flat, sizes = encode_rows(table, *ragged.text_bytes(batch.column(1).slice(i, j - i)), end_id)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int64)), pa.array(before + ends - sizes), pa.array(sizes), lists], schema.names)
                before += int(ends[-1])

    layout = {
        "compression": "zstd", "parquet.block.size": str(ROW_GROUP_BYTES), "parquet.page.size": str(PAGE_BYTES), "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in (key, "part", "part_start", "n_tokens")},
    }
    ordered.mapInArrow(run, schema).write.options(**layout).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The token files as a table; only the columns that a query names are read."""
    return spark.read.parquet(path)


def document_starts(tokens: DataFrame, files: DataFrame, start: str = "start") -> DataFrame:
    """``tokens``, which has part and part_start, with the number of ids of all documents before each row.

    ``files`` are the token files, of which only metadata is read here. The prefix
    sum runs over one row a file, never over documents.
    """
    totals = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("__total"))
    before = totals.select("part", (F.sum("__total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    return tokens.join(before, "part").withColumn(start, F.coalesce("__before", F.lit(0)) + F.col("part_start")).drop("__before")


def id_digests(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, file, place in the file, number of ids and their CRC-32, all from the ids as read."""
    schema = T.StructType([tokens.schema[key], *(T.StructField(n, T.LongType()) for n in ("part", "part_start", "n_tokens", "ids_crc32"))])

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            raw = memoryview(np.asarray(ids.values).astype("<u4").tobytes())
            at = np.asarray(ids.offsets).astype(np.int64) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at) // 4), pa.array(crc, pa.int64())], schema.names)

    return tokens.select(key, "part", "part_start", "ids").mapInArrow(run, schema)


def token_file_report(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the token files, reads them back and reports each document's start, length and CRC-32."""
    spark = docs.sparkSession
    path = path or shared.new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id, key, text)
    files = read_token_files(spark, path)
    return document_starts(id_digests(files, key), files).select(key, "start", "n_tokens", "ids_crc32")
