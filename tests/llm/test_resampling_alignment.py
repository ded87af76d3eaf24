"""Importance resampling and token alignment against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from scoreframe.llm import importance_resampling as ir
from scoreframe.llm import ragged
from scoreframe.llm import token_alignment as ta

DATA = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", None, " a", "a", "x" * 1000 + " y " + "z" * 300, "Éİ \x7f a-b", "\x00", "a\x00b c", "ß1 2ß", "the " * 30]


def grams(text):
    """Buckets of all features, and the number of words."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def brute_draw(rows, target):
    found = [(i, *grams(t)) for i, t in rows]
    s, t = Counter(b for _, f, _ in found for b in f), Counter(b for x in target for b in grams(x)[0])
    all_s, all_t, out = sum(s.values()), sum(t.values()), {}
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    for i, f, n in found:
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n]
    able = sorted((i for i in out if out[i][4] >= 20), key=lambda i: (-out[i][2], i))
    for rank, i in enumerate(able[: 5 * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(v[:4]) for i, v in out.items()}


def test_draw_equals_brute_force(spark):
    docs, target = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    odd = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd).repartition(5)
    rows, texts = [tuple(r) for r in docs.collect()], [r["text"] for r in target.collect()]
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in ir.resampled(docs, target).collect()}
    want = brute_draw(rows, texts)
    assert got == want and sum(v[3] is not None for v in want.values()) >= 9


def test_draw_edges(spark):
    """Ties, repeated rows, no key, empty tables and clashing columns."""
    text = "one two three " * 10
    rows = [(k, text) for k in range(300)] + [(5, text), (5, text), (None, text), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "2 AS rank", "'y' AS buckets", "1 AS n_words", "0 AS __at", "0 AS __out")
    target = spark.createDataFrame([(1, None), (2, "two three")], "item_id long, text string")
    got = ir.resampled(docs, target).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert len(got) == 305 and ranks == list(range(1, 16)) and ir.resampled(docs, target).columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(-r["score"], r["doc_id"] or -1) for r in drawn] == sorted((-r["score"], r["doc_id"] or -1) for r in drawn)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert ir.resampled(docs.limit(0), target).count() == 0
    assert {r["n_features"] for r in ir.resampled(docs, target.limit(0)).collect()} == {0, 87}


@pytest.mark.parametrize("most", [0, 3, 60_000])
def test_automaton_changes_nothing(most):
    rng, dictionary = random.Random(5), ir.WordDictionary(most=most)
    for _ in range(4):
        texts = [*ODD, *(" ".join("".join(rng.choice("abcÉ1") for _ in range(rng.randrange(1, 4))) + rng.choice(["", "-", "\n"]) for _ in range(rng.randrange(60))) for _ in range(200))]
        row, bucket, words = ir.features(dictionary, *ragged.text_bytes(pa.array(texts, pa.string())))
        for i, t in enumerate(texts):
            want, n = grams(t)
            assert sorted(bucket[row == i].tolist()) == sorted(want) and words[i] == n
    assert len(dictionary.words) <= most and (most < 100 or dictionary.automaton is not None)


def test_crc_of_long_parts():
    parts = [b"", b"a", b"word" * 40, b"x" * 1000, bytes(range(256)) * 30]
    for x in parts:
        for y in parts:
            got = ir.shifted(np.array([zlib.crc32(x)], np.uint32), np.array([len(y)])) ^ np.uint32(zlib.crc32(y))
            assert int(got[0]) == zlib.crc32(x + y)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


def brute_groups(libraries, text):
    """Ids of both sides, links and the groups' text; None for texts without tokens."""
    tokenizer, pieces = libraries
    if not text:
        return None
    of, said = ta._byte_of_character(), (" " + text).encode()
    a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    sides = [[bytes(of[c] for c in tokenizer.id_to_token(i)) for i in a], [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]]
    if any(b"".join(s) != said for s in sides):
        return None
    ends = [dict(zip(np.cumsum([len(t) for t in s]).tolist(), range(len(s)), strict=True)) for s in sides]
    groups, links, i, j = [], [], 0, 0
    for end in sorted(ends[0].keys() & ends[1].keys()):
        x, y = ends[0][end] + 1, ends[1][end] + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        links.append((a[x - 1], b[y - 1]))
        i, j = x, y
    return len(a), len(b), links, ";".join(groups)


def brute_report(libraries, rows):
    found = [(i, brute_groups(libraries, t)) for i, t in rows]
    counts = Counter(link for _, f in found if f for link in f[2])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n = [counts[x] for x in f[2]]
            out.append((i, f[0], f[1], len(f[2]), len(f[2]), sum(c == most[x[1]] for c, x in zip(n, f[2], strict=True)), sum(n), hashlib.sha256(f[3].encode()).hexdigest()))
    return sorted(out, key=str)


def test_alignment_equals_brute_force(spark, libraries):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "日", "1", "22", ".", "!", "<|endoftext|>", "<s>", "\r\n", "𝕏", "\x00", "the ", " hello"]
    texts = ["", None, " ", "<|endoftext|>", "</s>a", "▁", "a▁b", "x" * 5000, " " * 300] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()] + [(10_000 + k, t) for k, t in enumerate(texts)] + [(3, "twice"), (3, "twice"), (None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS pairs", "'y' AS n_a", "1 AS n_best").repartition(4)
    got = ta.alignment_report(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_report(libraries, rows)
    assert ta.alignment_report(docs.limit(0), A, B).count() == 0
    assert [tuple(r)[1:] for r in ta.alignment_report(docs.where("text IS NULL"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_counts_of_links_in_little_memory(spark, monkeypatch):
    """A batch of millions of links is counted, and its counts looked up, a few links at a time."""
    rng, runs = np.random.default_rng(3), []
    sizes = rng.integers(0, 700, 10_000)
    sizes[[0, 7, 9_999]] = 0, 600_000, 0
    ends = np.concatenate([[0], np.cumsum(sizes)])
    pairs, counts, best = rng.integers(0, 5000, ends[-1]).astype(np.int32), rng.integers(0, 1 << 40, 5000), rng.random(5000) < 0.5
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs))], ["doc_id", "pairs"])
    links = spark.createDataFrame([], "doc_id long, pairs array<int>")
    monkeypatch.setattr(type(links), "mapInArrow", lambda self, run, schema: (runs.append(run), spark.createDataFrame([], schema))[1])
    ta.counted(links, counts, best), ta.pair_counts(links, 5000)
    got, peaks = [], []
    for run, part in ((runs[0], batch.slice(1)), (runs[1], batch.select(["pairs"]).slice(1))):
        tracemalloc.start()
        got.append(next(iter(run([part]))))
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    for k, x in ((1, best), (2, counts)):
        upto = np.concatenate([[0], np.cumsum(x[pairs].astype(np.int64))])
        assert got[0].column(0).to_pylist() == list(range(1, 10_000)) and got[0].column(k).to_pylist() == (upto[ends[2:]] - upto[ends[1:-1]]).tolist()
    assert dict(zip(*(c.to_pylist() for c in got[1].columns), strict=True)) == dict(enumerate(np.bincount(pairs, minlength=5000).tolist()))
    assert max(peaks) < 8 * ends[-1] / 1e6, peaks


def test_pair_numbers(libraries):
    """Every pair that can end together has a number of its own, from which its piece follows."""
    both, rng = ta.aligner(A, B), random.Random(2)
    of, pairs = both.b_of_pairs(), {}
    known = {t: i for i, t in enumerate(both.b_bytes) if t and not both.b.is_byte[i]}
    for a in rng.sample(range(50_000), 4000):
        for k in range(1, len(both.a_bytes[a]) + 1):
            if (b := known.get(both.a_bytes[a][-k:])) is not None:
                pairs[a, b] = int(both.numbers(np.array([a]), np.array([b]))[0])
    longer = {t: i for i, t in enumerate(both.a_bytes) if t}
    for t, b in known.items():
        for k in range(1, len(t)):
            if (a := longer.get(t[-k:])) is not None:
                pairs[a, b] = int(both.numbers(np.array([a]), np.array([b]))[0])
    assert len(set(pairs.values())) == len(pairs) and max(pairs.values()) < both.n_pairs and min(pairs.values()) >= 0
    assert all(of[n] == b for (_, b), n in pairs.items())
