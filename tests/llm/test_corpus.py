"""Line dedup, near duplicates, mixing, language model and quality rules against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreframe.llm import language_model, line_dedup, mixing, near_duplicates, quality_rules, ragged, shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeated rows, a long text and a clashing column."""
    rows = [(1, "Same line here\nother", "s"), (2, "  SAME line HERE \nown text", "s"), (2, "  SAME line HERE \nown text", "s"), (3, None, None), (4, "", None), (None, "Same line here", "t"), (5, "w " * 40_000, "t"), (6, "short\nshort", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_line_dedup_equals_brute_force(docs):
    rows, holders = docs.select("doc_id", "text").collect(), defaultdict(set)
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    for i, text in rows:
        for line in text.split("\n"):
            holders[key(line)].add(i)
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    for i, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != i)]
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_line_dedup_edges(odd):
    got = sorted((r["doc_id"] or 99, r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_repeated_lines(odd.where("doc_id IS NULL OR doc_id <> 5").fillna({"text": "\0"})).replace("\0", None).collect() if r["doc_id"] != 3)
    assert got == [(1, "Same line here\nother", 2, 0), (2, "own text", 2, 1), (2, "own text", 2, 1), (4, "", 1, 0), (6, "short\nshort", 2, 0), (99, "", 1, 1)]
    assert line_dedup.drop_repeated_lines(odd.limit(0)).count() == 0
    assert [r["text"] for r in line_dedup.drop_repeated_lines(odd).where("doc_id = 3").collect()] == [None]


def test_minimal_perfect_hash():
    keys = ragged.mix(np.arange(5000, dtype=np.uint64))
    marks = np.repeat(np.arange(2500, dtype=np.uint64), 2)
    assert sorted(line_dedup.MinimalPerfectHash(keys, marks).slots(keys, marks).tolist()) == list(range(5000))


def shingles(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def alike(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for k in s:
            where[k].append(i)
    for i, j in {(i, j) for v in where.values() for i in v for j in v if i < j}:
        if alike(sets[i], sets[j]) >= 0.8:
            a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
            root[b] = a
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_near_duplicates_equal_brute_force(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.duplicate_classes(docs).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_with_a_common_passage(spark):
    """Near copies that are alike only through the original, and texts that share four fifths but aren't alike."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(300)], []
    for _ in range(60):
        copy = list(base)
        for k in rng.sample(range(2, 118), 2):
            copy[k] = word()
        rows.append(copy)
    rows += [[*passage, *(word() for _ in range(rng.randrange(42, 80)))] for _ in range(60)]
    rows = [(i, " ".join(r)) for i, r in enumerate([base, *rows])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.duplicate_classes(docs).collect()}
    assert got == brute_classes(sorted(rows))


def test_near_duplicates_of_low_entropy(spark):
    from test_codecs import ALIKE

    docs = spark.createDataFrame([*enumerate(ALIKE), (100, ALIKE[0]), (7, "other words of a document with a key that another row has")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates.duplicate_classes(docs).collect()))
    assert [r[:2] for r in got] == [*((i, i) for i in range(len(ALIKE))), (7, 7), (100, 0)][:7] + [(7, 7), (7, 7), (100, 0)]


def test_longer_bands_lose_no_pair(spark, monkeypatch):
    """Whatever the classes so far, all alike pairs of different classes meet in the longer bands and pass the filter of signatures."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, rows = [word() for _ in range(90)], []
    for _ in range(25):
        base = [*passage, *(word() for _ in range(rng.randrange(10, 40)))] if rng.random() < 0.6 else [word() for _ in range(80)]
        for _ in range(4):
            copy = list(base)
            for k in rng.sample(range(len(base)), rng.randrange(5)):
                copy[k] = word()
            rows.append(" ".join(copy[: len(copy) - rng.randrange(6)]))
    rows += ["a b a b a b a b a b a b", "a b a b a b a b a b a", "x y"]
    sets = [shingles(t) for t in rows]
    labels = [i - i % 2 for i in range(len(rows))]
    texts = shared.written(spark.createDataFrame([(i, t, labels[i]) for i, t in enumerate(rows)], "id long, text string, label long").repartition(5), "texts")
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if labels[i] != labels[j] and alike(sets[i], sets[j]) >= 0.8}
    marks = near_duplicates.sketches(texts.select("id", "text")).select("id", "marks")
    for few, number in ((16, len(rows)), (1, len(rows)), (0, 30_000)):  # by shingles and bands, and by as many bands as so many texts get
        monkeypatch.setattr(near_duplicates, "FEW", few)
        monkeypatch.setattr(near_duplicates, "sharper", lambda _, of=near_duplicates.sharper, n=number: of(n))
        crossing = near_duplicates._crossing_pairs(texts)
        got = {tuple(r) for r in crossing.collect()}
        kept = {tuple(r) for r in near_duplicates.hopeful(crossing, marks).collect()}
        assert want and want <= kept <= got and all(alike(sets[i], sets[j]) > 0.5 for i, j in kept)
    assert near_duplicates.hopeful(crossing.limit(0), marks).count() == 0


def test_near_duplicates_of_common_sentences(spark, monkeypatch):
    """Texts of 12 of 20 common sentences: every table stays within the bands' rows, pairs don't grow with the square, and no class is lost."""
    tables, write = {}, shared.written

    def written(df, name, **options):
        table = write(df, name, **options)
        tables[name] = tables.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(near_duplicates.shared, "written", written)
    held = {}
    for n in (400, 1600):
        rng = random.Random(3)
        sentences = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(rng.randrange(5, 9))) for _ in range(20)]
        rows = [(i, " ".join(sentences[k] for k in sorted(rng.sample(range(20), 12)))) for i in range(n)]
        tables.clear()
        got = {r["doc_id"]: r["class_id"] for r in near_duplicates.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        held[n] = dict(tables)
        if n == 400:
            assert got == brute_classes(rows)
    bands = {"sharp": near_duplicates.sharper(1600)[0], "met-again": near_duplicates.sharper(1600)[0]}
    assert all(rows <= bands.get(name, near_duplicates.BANDS) * 1600 for name, rows in held[1600].items())
    assert held[1600]["crossing"] <= 10 * held[400]["crossing"] and held[1600]["crossing"] < 0.01 * 1600 * 1599 / 2


def test_near_duplicate_edges(odd):
    got = sorted((tuple(r)[:3] for r in near_duplicates.duplicate_classes(odd).collect()), key=str)
    assert len(got) == 8 and (3, 3, 1) in got and (4, 4, 1) in got and (None, None, 1) in got
    assert near_duplicates.duplicate_classes(odd.limit(0)).count() == 0
    assert near_duplicates.one_of_each(odd).count() == 8


def test_columns_of_clashing_names(odd):
    """Columns named as those that the operators make change no result."""
    plain = lambda rows, names: sorted((tuple(r[n] for n in names) for r in rows.collect()), key=str)
    near = odd.selectExpr("*", *(f"'x' AS {n}" for n in ("id", "h1", "n_shingles", "buckets", "marks", "label", "rep", "n", "place", "size", "class_id", "class_size", "n_links", "__id")))
    names = ["doc_id", "class_id", "class_size", "n_links"]
    assert plain(near_duplicates.duplicate_classes(near), names) == plain(near_duplicates.duplicate_classes(odd), names)
    assert near_duplicates.one_of_each(near).columns == near.columns and near_duplicates.one_of_each(near).count() == 8
    judged = odd.selectExpr("*", *(f"'x' AS {n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept", "vote_length", "n")))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert plain(quality_rules.judged(judged), names) == plain(quality_rules.judged(odd), names)


def test_dart_signatures_estimate_similarity():
    a, b = "w " + " ".join(map(str, range(40))), "w " + " ".join(map(str, range(36))) + " x y z"
    data = ragged.text_bytes(pa.array([a, b]))
    row, element, count = near_duplicates.shingles(*data)
    s = near_duplicates.dart_signatures(row, element, count.astype(float), 2, 6000)
    assert abs((s[0] == s[1]).mean() - alike(shingles(a), shingles(b))) < 0.03


def brute_targets(sizes, most=3):
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight, total, fixed = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}, sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[n] for n in free)
        target = {n: left * weight[n] / share for n in free}
        over = [n for n in free if target[n] > most * sizes[n] + 1e-9]
        if not over:
            return target | fixed
        fixed |= {n: most * sizes[n] for n in over}


def test_mixing(docs, spark):
    counts = {r["doc_id"]: len(WORD.findall(r["text"])) for r in docs.collect()}
    got, sizes = mixing.mixing_report(docs).collect(), Counter()
    for r in got:
        assert r["size"] == counts[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
    want = brute_targets(sizes)
    assert all(r["target"] == pytest.approx(want[r["source"]], rel=1e-9) and r["source_size"] == sizes[r["source"]] for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixing_report(docs.repartition(7)).collect()))
    many = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', cast(5 + id % 90 AS int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 30 = 1 THEN 'rare' ELSE concat('s', id % 4) END AS source")
    rows = mixing.mixing_report(many).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(taken[s] == pytest.approx(target[s], rel=0.02) for s in target)
    assert mixing.mixed(many).count() == sum(r["copies"] for r in rows)


def test_mixing_edges(odd, spark):
    got = mixing.mixing_report(odd).collect()
    assert len(got) == 8 and all(r["copies"] <= 3 for r in got)
    assert {r["source"]: r["target"] for r in got}[None] == 0
    assert mixing.mixing_report(odd.limit(0)).count() == 0 and mixing.mixed(odd.limit(0)).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["rate", "offset", "strata", "source_no", "target", "copies", "taken", "source_size", "size", "n"]
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 40 AS int)) AS text", "concat('s', id % 3) AS source", *(f"concat('{n}', id) AS {n}" for n in names))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got.collect() for n in names)
    assert mixing.mixing_report(docs).columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]


def test_mixing_reruns_agree_for_equal_keys(spark):
    rows = [(i // 50 if i < 200 else None, f"w w w {i}", "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted((r["text"] for r in mixing.mixed(docs.repartition(n)).collect())) for n in (3, 11))
    assert first == again and len(first) > 300


def test_language_model_base(docs):
    tokens = {i: [*WORD.findall(t.translate(LOWER)), "\n"] for i, t in docs.select("doc_id", "text").collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i in tokens}
    seen = Counter(w for i, ws in tokens.items() if fold[i] for w in ws)
    n, v = sum(seen.values()), len(seen)
    got = {r["doc_id"]: r for r in language_model.scored_documents(docs).collect()}
    assert set(got) == set(tokens)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold[i] == 0, len(ws), sum(seen[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_scores(rows):
    """The whole method in plain dictionaries; ratios and counts are told apart to 1/32 of an octave, as the docstring says."""
    fine, tokens = language_model.FINE, {i: [*WORD.findall((t or "").translate(LOWER)), "\n"] for i, t in rows}
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i in tokens}

    def counts(folds):
        words, pairs, starts = Counter(), Counter(), 0
        for i, ws in tokens.items():
            if fold[i] in folds:
                words.update(ws), pairs.update(zip(["^", *ws], ws, strict=False))
                starts += 1
        return words, pairs, Counter({**words, "^": starts})

    def em(cases):
        share = 0.5
        for _ in range(200):
            share = min(sum(n * (1.0 if r == math.inf else share * r / (share * r + 1 - share)) for r, n in cases.items()) / sum(cases.values()), 1 - 1e-6)
        return share

    def middle(x):
        return 2 ** ((math.floor(math.log2(x) * fine) + 0.5) / fine)

    (words, pairs, before), (held, held_pairs, _) = counts(range(2, 10)), counts([1])
    n, v = sum(words.values()), len(words)
    cases = Counter()
    for w, c in held.items():
        cases[middle(words[w]) / n * (v + 1) if words[w] else 0.0] += c
    unigram = em(cases)
    by_context = defaultdict(Counter)
    for (a, w), c in held_pairs.items():
        if before[a]:
            ratio = pairs[a, w] / before[a] / (unigram * words[w] / n + (1 - unigram) / (v + 1))
            by_context[int(math.log2(before[a]))][middle(ratio) if ratio else 0.0] += c
    mixture = {b: em(c) for b, c in by_context.items()}
    words, pairs, before = counts(range(1, 10))
    n, v = sum(words.values()), len(words)

    def chance(a, w):
        low = unigram * words[w] / n + (1 - unigram) / (v + 1)
        share = mixture.get(int(math.log2(before[a])), 0.0) if before[a] else 0.0
        return share * pairs[a, w] / max(before[a], 1) + (1 - share) * low

    return {i: sum(math.log10(chance(a, w)) for a, w in zip(["^", *ws], ws, strict=False)) for i, ws in tokens.items()}


def test_language_model_score_equals_brute_force(spark, docs):
    from test_codecs import ALIKE

    rows = [*map(tuple, docs.select("doc_id", "text").collect()), *((10**6 + i, f"{t} {t} end") for i, t in enumerate(ALIKE)), (10**6 + 50, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = {r["doc_id"]: r["score"] for r in language_model.scored_documents(table.repartition(3)).collect()}
    want = brute_scores(rows)
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)


def test_language_model_sums_to_one_and_learns():
    w = language_model.Weights(100, 3, 10, 0.9, np.full(language_model.CONTEXTS, 0.7))
    counts = np.array([60, 30, 10, 0])
    assert w.chance(np.array([5, 3, 2, 0]), np.array([10] * 4), counts).sum() == pytest.approx(1)
    rng = np.random.default_rng(0)
    ratio = np.where(rng.random(20_000) < 0.3, 8.0, 0.2)
    share, grid = language_model.learned_share(np.ones(20_000), ratio), np.linspace(0.001, 0.999, 999)
    likelihood = [np.log(s * ratio + 1 - s).sum() for s in grid]
    assert share == pytest.approx(grid[int(np.argmax(likelihood))], abs=0.002)


def test_language_model_edges(odd, spark):
    got = language_model.scored_documents(odd).collect()
    assert len(got) == 8 and sorted(r["n_tokens"] for r in got)[:2] == [1, 1] and all(math.isfinite(r["score"]) for r in got)
    assert language_model.scored_documents(odd.limit(0)).count() == 0
    ids = [r["doc_id"] for r in language_model.scored_documents(spark.createDataFrame([(2**63 - 1, "a"), (None, "a"), (0, "b")], "doc_id long, text string")).collect()]
    assert sorted(ids, key=str) == [0, 2**63 - 1, None]


def test_language_model_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (language_model.unpack_sorted(language_model.pack_sorted(keys)) == keys).all()
    counts = np.array([0, 254, 255, 256, 10**12])
    assert (language_model.unpack_counts(language_model.pack_counts(counts), 5) == counts).all()


def test_quality_measures_equal_brute_force(docs):
    got = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    for i, text in docs.select("doc_id", "text").collect():
        w = WORD.findall(text)
        windows, inside, seen, again = Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
        for k in range(len(w) - 2):
            if windows[tuple(w[k : k + 3])] > 1:
                inside |= {k, k + 1, k + 2}
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(inside))
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["quality"] >= 0.5)


def test_quality_follows_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judged(docs).where("NOT base_failed").withColumnRenamed("quality", "p").join(labels, "doc_id").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.97


def test_quality_em_equals_plain_em(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        good = rng.random() < 0.8
        rows.append(tuple((1 if good else -1) * (1 if rng.random() < 0.85 else -1) if rng.random() < 0.9 else 0 for _ in quality_rules.VOTES))
    patterns = Counter(rows)
    frame = spark.createDataFrame([(*p, n) for p, n in patterns.items()], ", ".join(f"vote_{v} int" for v in quality_rules.VOTES) + ", n long")
    model = quality_rules.learned(frame, rounds=4)
    post = {p: 0.95 * 0.25 ** sum(v == -1 for v in p) for p in patterns}
    for _ in range(4):
        good = sum(n * post[p] for p, n in patterns.items()) + 1
        bad = sum(n * (1 - post[p]) for p, n in patterns.items()) + 1
        tables = []
        for k in range(len(quality_rules.VOTES)):
            pair = []
            for kind in (0, 1):
                c = [1 + sum(n * (post[p] if kind else 1 - post[p]) for p, n in patterns.items() if p[k] == said) for said in (-1, 0, 1)]
                pair.append([x / sum(c) for x in c])
            tables.append(pair)
        for p in post:
            odds = math.log(good / bad) + sum(math.log(t[1][v + 1]) - math.log(t[0][v + 1]) for t, v in zip(tables, p, strict=True))
            post[p] = 1 / (1 + math.exp(-odds))
    assert model["good"] == pytest.approx(good / (good + bad))
    assert all(model[v][1] == pytest.approx(t[1]) for v, t in zip(quality_rules.VOTES, tables, strict=True))


def test_quality_edges(odd):
    got = quality_rules.judged(odd).collect()
    assert len(got) == 8 and all(r["base_failed"] for r in got) and not any(r["kept"] for r in got)
    assert quality_rules.judged(odd.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 50, 200])
def test_line_dedup_in_any_chunks(docs, parts):
    """Chunks that hold first holders only, or one document each, give the rows of one chunk."""
    want = sorted(line_dedup.drop_repeated_lines(docs).select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert sorted(line_dedup.drop_repeated_lines(docs.repartition(parts)).select("doc_id", "text", "n_lines", "n_dropped").collect()) == want


def test_line_dedup_one_shared_line(spark):
    from test_codecs import ALIKE

    rows = [(1, "a line that two share", "x"), (2, "a line that two share\nmine", "y"), (3, "nothing shared here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string").repartition(3)
    assert sorted((r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup.drop_repeated_lines(docs).collect()) == [(1, rows[0][1], 0), (2, "mine", 1), (3, rows[2][1], 0)]
    kept = line_dedup.cut_documents(docs)
    assert kept.columns == docs.columns and sorted(r["n_lines"] for r in kept.collect()) == ["x", "y", "z"]
    alike = spark.createDataFrame(list(enumerate(ALIKE)), "doc_id long, text string")
    assert not any(r["n_dropped"] for r in line_dedup.drop_repeated_lines(alike).collect())


def test_line_index_turns_other_lines_away():
    """The perfect hash alone gives slots to lines that it wasn't built from; the fingerprint decides."""
    keys = ragged.mix(np.arange(4000, dtype=np.uint64))
    marks = ragged.mix(keys + np.uint64(9))
    first, last = np.arange(4000), np.arange(4000) + np.arange(4000) % 2
    index = line_dedup.LineIndex(keys, marks, first, last, np.ones(4000, np.uint32))
    found, low = index.probe(keys, marks)
    assert (found == (np.arange(4000) % 2 == 1)).all() and (low[found] == first[found]).all()
    assert (index.hash.slots(keys[::2], marks[::2]) >= 0).sum() > 100
    same_key = line_dedup.LineIndex(keys[[1, 1, 3, 3]], marks[[1, 2, 3, 3]], np.array([5, 6, 7, 8]), np.array([5, 6, 7, 8]), np.ones(4, np.uint32))
    assert same_key.probe(keys[[1, 1, 3]], marks[[1, 2, 3]])[0].tolist() == [False, False, True]
