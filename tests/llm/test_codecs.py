"""SentencePiece and token files against the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from scoreframe.llm import ragged, token_files
from scoreframe.llm import sentencepiece_codec as codec

MODEL, BYTES = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
ODD = ["", "   ", " " * 3000 + "x" * 3000, "▁a ▁", "\n\n a\n", "  x", "<s></s><0x41>", "日本語𝕏​", "\x00a", "ﬁ ½ Å"]


def texts(parts, n, most, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_sentencepiece_equals_library():
    import sentencepiece

    lib, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), codec.piece_table(MODEL)
    pieces = [lib.id_to_piece(i).replace("▁", " ") for i in range(259, 32000, 7)]
    many = ODD + texts(list("aab  \n\tte hin▁é日𝕏 \x00\r,.<>"), 1500, 60) + texts(pieces, 2000, 12)
    flat, sizes = codec.encode_batch(table, many)
    ends, want = np.cumsum(sizes), lib.encode(many)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [w + [2] for w in want]
    assert [d.decode() for d in codec.decode_rows(table, flat.astype(np.int64), sizes)] == [lib.decode(w + [2]) for w in want]


def test_decoding_any_ids_equals_library():
    import sentencepiece

    lib, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(3)
    rows = [[rng.randrange(600) for _ in range(rng.randrange(8))] for _ in range(1500)]
    flat = np.array([i for r in rows for i in r], np.int64)
    got = codec.decode_rows(codec.piece_table(MODEL), flat, np.array([len(r) for r in rows]))
    assert [g.decode() for g in got] == [lib.decode(r) for r in rows]


def test_sentencepiece_frames(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "Hello  world", "k"), (2, "Hello  world", "k"), (None, "b " * 50_000, "k")], "doc_id long, text string, token_ids string")
    got = codec.round_trip_digests(docs, MODEL).collect()
    assert len(got) == 5 and sorted(r["n_tokens"] for r in got)[:2] == [1, 1]
    empty = hashlib.sha256(b"2").hexdigest()
    assert sum(r["ids_sha256"] == empty for r in got) == 2
    back = codec.decode(codec.encode(docs, MODEL), MODEL)
    assert back.where("decoded <> coalesce(text, '')").count() == 0 and back.columns == ["doc_id", "text", "token_ids", "decoded"]
    assert codec.round_trip_digests(docs.limit(0), MODEL).count() == 0


def test_byte_level_pieces_equal_library():
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", " ", "　", "日", "1", "22", ".", "!", "<|endoftext|>", " ", "\x1c", "​", "\r\n", "'ll", "𝕏", "\x00", "̈", "٣"]
    many, table = ["", " "] + texts(parts, 6000, 25), token_files.byte_level_table(BYTES)
    flat, sizes = token_files.encode_rows(table, *ragged.text_bytes(pa.array(many)), 2)
    ends, want = np.cumsum(sizes), [e.ids for e in table.tokenizer.encode_batch(many, add_special_tokens=False)]
    assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [w + [2] for w in want]


def test_token_files_without_keys(spark, tmp_path, monkeypatch):
    """Rows without a key, of one key, and equal ones are spread over files; clashing columns aren't read."""
    monkeypatch.setattr(token_files, "FILE_TEXT_BYTES", 4000)
    rows = [(None, f"text {i} of many") for i in range(900)] + [(5, "same")] * 700 + [(9, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS part", "1 AS n_tokens", "'y' AS ids", "'z' AS __hash").repartition(4)
    path = f"file://{tmp_path}/files"
    got = token_files.token_file_report(docs, BYTES, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 900 + [5] * 700 + [9]
    ends = np.cumsum([r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == [0, *ends[:-1].tolist()]
    sizes = [r["n"] for r in token_files.read_token_files(spark, path).groupBy("part").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) >= 4 and max(sizes) < 1000
    table = token_files.byte_level_table(BYTES)
    want = Counter(zlib.crc32(np.array(table.tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for _, t in rows)
    assert Counter(r["ids_crc32"] for r in got) == want


@pytest.mark.parametrize("n", [0, 300])
def test_token_files(spark, tmp_path, n):
    rng, table = random.Random(5), token_files.byte_level_table(BYTES)
    rows = [(i, None if i % 50 == 0 else " ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randrange(40)))) for i in rng.sample(range(1000), n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = f"file://{tmp_path}/files"
    got = sorted(token_files.token_file_report(docs, BYTES, path).collect())
    start = 0
    for (i, text), r in zip(sorted(rows), got, strict=True):
        ids = np.array(table.tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    if n:
        import pyarrow.parquet as pq

        file = next((tmp_path / "files").glob("*.parquet"))
        columns = pq.ParquetFile(file).metadata.row_group(0)
        encodings = {columns.column(i).path_in_schema.split(".")[0]: columns.column(i) for i in range(columns.num_columns)}
        assert "DELTA_BINARY_PACKED" in encodings["doc_id"].encodings and encodings["ids"].has_offset_index


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


ALIKE = [thue_morse(n, swap) for n in (1024, 2048, 4096, 5000) for swap in (False, True)]


def test_low_entropy_words_and_long_runs_equal_libraries():
    """Strings that collide under polynomial hashes, and runs without white space."""
    import base64

    import sentencepiece

    rng = random.Random(8)
    runs = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(5000)), base64.b64encode(rng.randbytes(6000)).decode(), "ab" * 4000, "http://" + "a1/" * 2000, "é" * 3000, "x" * 2500 + "日" * 2500]
    many = [*ALIKE, *runs, *(f"w {t} w" for t in ALIKE), *runs]
    lib, table = sentencepiece.SentencePieceProcessor(model_file=MODEL), codec.piece_table(MODEL)
    for texts_ in (many, many[::-1]):
        flat, sizes = codec.encode_batch(table, texts_)
        ends = np.cumsum(sizes)
        assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [w + [2] for w in lib.encode(texts_)]
        table6 = token_files.byte_level_table(BYTES)
        flat, sizes = token_files.encode_rows(table6, *ragged.text_bytes(pa.array(texts_)), 2)
        ends = np.cumsum(sizes)
        want = [e.ids + [2] for e in table6.tokenizer.encode_batch(texts_, add_special_tokens=False)]
        assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == want


def test_byte_level_cuts_beside_punctuation_and_added_tokens():
    parts = ["don", "'t", "'", "x1", "1a", ",", "<|endoftext|>", "<|endoftext", "|>", " ", "\n", "é", "—", "“", "_", "́", "…", "\x85", "A.b", "''s", "s'", "\x1c"]
    many, table = texts(parts, 8000, 12, seed=11), token_files.byte_level_table(BYTES)
    flat, sizes = token_files.encode_rows(table, *ragged.text_bytes(pa.array(many)), 2)
    ends, want = np.cumsum(sizes), [e.ids for e in table.tokenizer.encode_batch(many, add_special_tokens=False)]
    assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [w + [2] for w in want]


def test_word_store_survives_collisions_and_renewal(monkeypatch):
    """Equal hashes of different words, and a store that must make room, give the same ids."""
    rows = texts(list("abcdefgh"), 400, 12, seed=3)
    data, offsets = ragged.text_bytes(pa.array(rows))
    starts, ends = offsets[:-1], offsets[1:]
    real = ragged.span_hashes
    for hashes in (real, lambda *a: real(*a) % np.uint64(5), lambda *a: np.zeros(len(a[1]), np.uint64)):
        monkeypatch.setattr(ragged, "span_hashes", hashes)
        store = ragged.WordIds(most=50, say=True)
        for _ in range(4):
            encode = lambda k: (data[ragged.ragged_index(starts[k], (ends - starts)[k])].astype(np.int32), (ends - starts)[k])
            words = store.numbers(data, starts, ends, encode)
            flat, upto = store.ids_of(words)
            assert flat.tolist() == data.tolist() and upto.tolist() == offsets.tolist()
            assert [store.said[w] for w in words] == [" ".join(map(str, r.encode())).encode() for r in rows]


def test_span_hashes():
    data = np.random.default_rng(0).integers(97, 99, 40_000).astype(np.uint8)
    starts = np.arange(0, 30_000, 7)
    ends = starts + np.tile([0, 1, 8, 9, 511, 512, 513, 2000], len(starts))[: len(starts)]
    hashes, raw = ragged.span_hashes(data, starts, ends), data.tobytes()
    words = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
    assert len(set(hashes.tolist())) == len(set(words)) and len({*zip(words, hashes.tolist(), strict=True)}) == len(set(words))
    other = ragged.span_hashes(np.concatenate([[0], data]).astype(np.uint8), starts + 1, ends + 1)
    assert (other == hashes).all() and not (ragged.span_hashes(data, starts, ends, 5) == hashes).any()
    both = [ragged.span_hashes(*(lambda d, o: (d, o[:-1], o[1:]))(*ragged.text_bytes(pa.array([thue_morse(n, s) for s in (False, True)])))) for n in (1024, 2048, 4096)]
    assert all(a != b for a, b in both)
