"""URL filter, toxicity, nearest neighbours and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scoreframe.llm import mixing, nearest_neighbours, ragged, shared, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def ruled(host, path):
    fits = [(len(h + p), h + p, said) for said, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def classes(text):
    return "".join("0" if c in "0123456789" else c if c in url_filter.SYMBOLS[:26] + "./-" else "*" for c in text.lower())


class Markov:
    def __init__(self, texts):
        self.n = [Counter() for _ in range(url_filter.ORDER + 1)]
        for t in texts:
            t = "^" * url_filter.ORDER + classes(t)
            for i in range(url_filter.ORDER, len(t)):
                for k in range(url_filter.ORDER + 1):
                    self.n[k][t[i - k : i + 1]] += 1
        self.after = [Counter() for _ in self.n]
        self.kinds = [Counter() for _ in self.n]
        for k, counts in enumerate(self.n):
            for gram, n in counts.items():
                self.after[k][gram[:-1]] += n
                self.kinds[k][gram[:-1]] += 1

    def chance(self, gram):
        p = 1 / len(url_filter.SYMBOLS)
        for k in range(url_filter.ORDER + 1):
            g = gram[url_filter.ORDER - k :]
            if total := self.after[k][g[:-1]]:
                p = (self.n[k][g] + self.kinds[k][g[:-1]] * p) / (total + self.kinds[k][g[:-1]])
        return p


def test_url_filter_equals_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url")
    got = {r["page_id"]: r for r in url_filter.judged(pages).collect()}
    parts = {r["t"]: r["p"] for r in spark.createDataFrame([("".join(parse(r["url"])),) for r in got.values()], "t string").distinct().selectExpr("t", f"pmod(xxhash64(t), {url_filter.CALIBRATION_PARTS}) AS p").collect()}
    said, texts = {}, {True: set(), False: set()}
    for r in got.values():
        host, path = parse(r["url"])
        rule, verdict = ruled(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if verdict:
            assert r["verdict"] == verdict
            if parts[host + path]:
                texts[verdict == "allow"].add(host + path)
        else:
            said[host + path] = (r["score"], r["verdict"])
    good, bad = Markov(texts[True]), Markov(texts[False])
    assert said
    for text, (score, _) in said.items():
        t = "^" * url_filter.ORDER + classes(text)
        grams = [t[i - url_filter.ORDER : i + 1] for i in range(url_filter.ORDER, len(t))]
        assert score == pytest.approx(sum(math.log(good.chance(g) / bad.chance(g)) for g in grams) / len(grams), rel=1e-9, abs=1e-12)
    allowed, blocked = ([s for s, v in said.values() if v == kind] for kind in ("allow", "block"))
    assert not allowed or not blocked or min(allowed) >= max(blocked)


def test_url_filter_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.COM"), (3, "http://A.COM"), (4, "http://a.com/x?y#z"), (5, "http://www.example.com/en/1"), (6, "http://example.com/en/1"), (7, "x://h.net/es/" + "a" * 30_000), (8, "ftp://Höst/ü")]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in rows], "page_id long, url string, verdict string")
    got = url_filter.judged(pages).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 9 and (by[1]["host"], by[2]["path"], by[3]["host"], by[3]["rule"]) == ("", "", "a.com", None)
    assert [by[i]["rule"] for i in (4, 5, 6, 7)] == ["com/", "www.example.com/en/", "example.com/en/", "net/es/"]
    assert {r["verdict"] for r in got} <= {"allow", "block"} and by[6]["verdict"] == by[7]["verdict"] == "block"
    assert url_filter.judged(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judged(pages.where("page_id < 4")).collect()} == {"allow"}


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = toxicity.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").select("toxic", "rejected", "expected_severity").collect()
    bad, good = ([r for r in rows if r["toxic"] == t] for t in (1, 0))
    assert len(bad) > 50 and np.mean([r["rejected"] for r in bad]) > 0.9 and np.mean([r["rejected"] for r in good]) < 0.02
    assert (np.diff(model.thresholds) > 0).all()


def test_toxicity_gradient_and_edges(spark):
    rng = np.random.default_rng(0)
    features = toxicity.FeatureSet(np.array([3, 5], np.uint64))
    column, row = np.tile([0, 1], 600), np.repeat(np.arange(600), 2)
    value = rng.random(1200) * 3
    z = 2 * value[0::2] - 1 * value[1::2] + rng.logistic(size=600)
    grade = np.searchsorted([1.0, 3.0, 5.0], z)
    model = toxicity.OrdinalModel.fit(features, column, row, value, grade, steps=1500)
    assert model.weights == pytest.approx([2, -1], abs=0.4) and model.thresholds == pytest.approx([1, 3, 5], abs=0.7)
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "fine words only"), (None, "bad " * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 0, 1), (2, None, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r["expected_severity"] <= toxicity.GRADES for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_word_features():
    a, b = (set(toxicity.word_features(*ragged.text_bytes(pa.array([t])))[0].tolist()) for t in ("Prefixes, and", "(prefixed) x"))
    assert len(a & b) == 3


def test_neighbours_recall_and_order(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = nearest_neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"), shard_rows=200).collect()
    rows = vectors.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    norm, hits, total = np.sqrt((x * x).sum(axis=1)), 0, 0
    for q in ids[ids % 50 == 0]:
        me = int(np.flatnonzero(ids == q)[0])
        cosine = x @ x[me] / (norm * norm[me])
        want = [i for i in ids[np.lexsort((ids, -cosine))] if i != q][:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(s == pytest.approx(cosine[ids == i][0], rel=1e-12) for _, i, s in mine)
        hits, total = hits + len({i for _, i, _ in mine} & set(want)), total + 5
    assert hits / total >= 0.95


def test_neighbours_in_a_dense_group():
    rng = np.random.default_rng(1)
    dense = rng.normal(size=64) * 3 + rng.normal(size=(600, 64)) * 0.1
    x = np.concatenate([dense, rng.normal(size=(1500, 64))])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    graph = nearest_neighbours.PrunedGraph(x)
    queries = x[::50]
    found, _ = graph.search(queries.astype(np.float32), nearest_neighbours.SEARCH_BEAM)
    want = np.argsort(-(queries @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(f.tolist()) & set(w)) / 6 for f, w in zip(found, want.tolist(), strict=True)]) >= 0.9


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (8, []), (9, [float("inf"), 1.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, nearest_neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect()))
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 7), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 7)]
    assert [s for *_, s in got][:4] == [1.0, 1.0, 1.0, 0.0]
    many = spark.range(0, 400).selectExpr("id AS vec_id", "array(1f, 2f) AS embedding")
    same = nearest_neighbours.nearest(many, many.where("vec_id = 3")).orderBy("rank").collect()
    assert [r["vec_id"] for r in same] == [0, 1, 2, 4, 5]
    assert nearest_neighbours.nearest(vectors.limit(0), vectors).count() == 0


def test_neighbours_of_any_size(spark):
    """Very small and very large vectors, and ones of both kinds of component, change neither recall nor scores."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    scale = np.ones(600)
    scale[[7, 100]], scale[[8, 150]], scale[[9, 200]] = 1e-170, 1e200, 5e-324 * 2**40
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, scale, strict=True))] + [(600, [1e300] * 8 + [1e-300] * 8), (650, [1e-310] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = nearest_neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0")).collect()
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    unit = {i: v / np.sqrt(v @ v) for i, v in unit.items()}
    hits, queries = 0, [i for i in unit if i % 50 == 0]
    for q in queries:
        cosine = {i: float(v @ unit[q]) for i, v in unit.items() if i != q}
        mine = [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(mine) == 5 and all(s == pytest.approx(cosine[i], abs=1e-9) for i, s in mine)
        hits += len({i for i, _ in mine} & set(sorted(cosine, key=lambda i: (-cosine[i], i))[:5]))
    assert hits >= 0.95 * 5 * len(queries)


def test_neighbours_of_each_length(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=(4, 6, 3)[i % 3] if i != 60 else 6).tolist()) for i in range(120)]
    vectors = spark.createDataFrame([(*r, "mine") for r in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = nearest_neighbours.nearest(vectors, vectors.where("vec_id % 10 = 0"), shard_rows=15).collect()
    assert Counter(r["query_id"] for r in got) == {q: 5 for q in range(0, 120, 10)}
    for q in range(0, 120, 10):
        v = np.array(rows[q][1])
        cosine = {i: v @ np.array(x) / np.sqrt((v @ v) * (np.array(x) @ np.array(x))) for i, x in rows if i != q and len(x) == len(v)}
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == sorted(cosine, key=lambda i: (-cosine[i], i))[:5]


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on its own input: toxicity by the model's formula, all others against plain versions of the operators."""
    import duckdb
    import public_tokenizers
    import sentencepiece
    from test_corpus import WORD, LOWER, brute_classes

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"rejected": F.concat(F.lit("r"), "doc_id"), "n_lines": F.lit("mine"), "target": F.col("doc_id")})
    columns = docs.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mix", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet")) if name == "toxicity" else None
        docs = shared.written(stage(spark, docs, DATA), "stage")
        got = [r.asDict() for r in docs.collect()]
        assert name == "tokens" or (docs.dtypes == columns and all(r["rejected"] == f"r{r['doc_id']}" and r["n_lines"] == "mine" and r["target"] == r["doc_id"] for r in got))
        if name == "toxicity":
            cut = max(math.log(0.2 / 0.8), math.log(10) - model.thresholds[0])
            kept = {r["doc_id"] for r in before if brute_score(model, r["text"]) - model.thresholds[0] < cut}
            assert {r["doc_id"] for r in got} == kept
        if name == "line dedup":
            key, holders = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER), {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                for x in r["text"].split("\n"):
                    holders.setdefault(key(x), r["doc_id"])
            want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if len(key(x)) < 10 or holders[key(x)] == r["doc_id"]) for r in before}
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got} == {i: (t, len(t)) for i, t in want.items()}
        if name == "near dedup":
            classes = brute_classes([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"] for r in got} == {i for i, c in classes.items() if i == c}
        if name == "mix":
            con = duckdb.connect()
            documents = pa.Table.from_pylist([{k: r[k] for k in ("doc_id", "source", "text")} for r in before])
            con.register("documents", documents)
            rows = con.execute(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall()
            assert Counter(r["doc_id"] for r in got) == Counter({i: c for i, c in rows if c})
            assert {r["doc_id"]: r["text"] for r in got}.items() <= {r["doc_id"]: r["text"] for r in before}.items()
        if name == "tokens":
            lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            want = [(r["doc_id"], len(i) + 1, sha(" ".join(map(str, [*i, 2]))), sha(lib.decode(i))) for r in before for i in [lib.encode(r["text"])]]
            assert sorted(map(tuple, docs.collect())) == sorted(want)
    assert WORD and len(got) > 50


def brute_score(model, text):
    """w.x of a text, from its words one by one."""
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    counts = Counter()
    for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        word = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
        for _ in range(3):
            word = word[1:] if len(word) > 1 and chr(word[0]) in marks else word
            word = word[:-1] if len(word) > 1 and chr(word[-1]) in marks else word
        whole = np.frombuffer(word, np.uint8)
        counts[int(ragged.span_hashes(whole, np.array([0]), np.array([len(word)]))[0])] += 1
        for k in toxicity.PREFIXES:
            if len(word) > k:
                counts[int(ragged.mix(np.array([int.from_bytes(word[:k], "little") + (k << 56)], np.uint64))[0])] += 1
    weights = dict(zip(model.features.hashes.tolist(), model.weights.tolist(), strict=True))
    return sum(weights[h] * math.log1p(n) for h, n in counts.items() if h in weights)


def test_toxicity_equals_brute_force_and_catches_every_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = toxicity.score(docs.select("doc_id", "text", "lang"), model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        bad, good = ([r["rejected"] for r in rows if r["lang"] == lang and r["toxic"] == t] for t in (1, 0))
        assert len(bad) > 10 and np.mean(bad) > 0.85 and np.mean(good) < 0.05
    assert len(model.features.hashes) > 20
    for r in rows[::15]:
        z = brute_score(model, r["text"])
        want = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        assert [r[f"p_grade_{g}"] for g in (1, 2, 3)] == pytest.approx(want, rel=1e-9) and r["expected_severity"] == pytest.approx(sum(want), rel=1e-9)


def test_pipeline_run_leaves_no_tables_but_the_last(spark):
    from pathlib import Path

    got = corpus_pipeline.run(spark, DATA)
    folder = Path(shared.shared_folder(spark).removeprefix("file://"))
    assert got.count() > 50 and not [*folder.glob("toxicity-*"), *folder.glob("line-dedup-*"), *folder.glob("near-dedup-*")] and [*folder.glob("mix-*")]


def test_pipeline_handles_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11), (3, "w " * 20_000, "en", "t", 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = shared.written(stage(spark, table, DATA), "odd")
        assert table.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_random_urls_parse(spark):
    rng = random.Random(9)
    urls = ["".join(rng.choice(["http", "://", "/", "?", "#", "A.com", "en", ".", "net", "é"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    got = url_filter.with_host_and_path(spark.createDataFrame([(u,) for u in urls], "url string")).collect()
    assert [(r["host"], r["path"]) for r in got] == [parse(r["url"]) for r in got]


def test_toxicity_learns_rare_wordings_from_all_labels(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(20)) + (f" {('grobian', 'canalla')[i % 2]}" if i < 24 else "")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(3000).selectExpr("id AS doc_id", "int(id < 24) AS toxic")
    got = toxicity.score(docs, toxicity.fit(docs, labels, most=600)).collect()
    assert {r["doc_id"] for r in got if r["rejected"]} == set(range(24))
    assert np.mean([r["p_grade_1"] for r in got if r["doc_id"] >= 24]) < 0.02


def test_toxicity_draws_by_label(spark):
    labelled = spark.range(1000).selectExpr("'t' AS text", "int(id < 300) AS toxic", "id AS __id")
    for n_bad, most, want in ((300, 600, (300, 300)), (300, 400, (200, 200)), (300, 2000, (300, 700))):
        drawn = [r["toxic"] for r in toxicity._drawn(labelled, n_bad, 1000 - n_bad, most).collect()]
        assert (sum(drawn), len(drawn) - sum(drawn)) == want
