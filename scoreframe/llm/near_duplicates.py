"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

A document is the multiset of its five-word shingles; similarity is the weighted
Jaccard similarity of the multisets. Darts are thrown by hashing into the unit
cells (weight by rank) of each element's region; each signature coordinate keeps
the earliest dart that falls to it, so two coordinates agree with the similarity's
probability. Documents that agree in all coordinates of a band meet in a bucket.

Equal texts are collapsed first. In a bucket everyone is compared with one centre
(who meets most others in all bands), which settles buckets of one class and those
where only the centre is of another. Of the texts that meet in the other buckets,
those that share one of their rarest shingles are compared, an exact filter. Where
many texts share it, such as texts made of common sentences, they get signatures
with longer bands, more of them the more such texts there are: texts that are half
alike then rarely meet, and alike ones still do. Pairs whose signatures agree in too
few coordinates are dropped unread; each kept link is verified on whole texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.llm import ragged, shared

#: Bytes of text handled at a time: darts take some sixty times as much.
CHUNK_BYTES = 512 << 10
SHINGLE = 5
SIMILARITY = 0.8
#: 48 bands of 6 coordinates: a pair of similarity 0.8 is missed with probability 5e-7.
BANDS, BAND_ROWS = 48, 6
#: Cells in which shingles are counted for their order, and rows that they are sent in. A count stops at MOST_COUNT.
CELLS, SLICES, MOST_COUNT = 1 << 22, 64, (1 << 16) - 1
#: Texts that meet in pairs by a shingle; where more have it, longer bands find the alike ones.
FEW = 16
#: A pair of similarity 0.8 is missed by the longer bands with a probability of e to the minus this.
SHARP_MISS = 14.5
#: Share of coordinates that agree, below which a pair isn't read: 5 standard deviations under that of similarity 0.8.
LEAST_AGREED = 0.68
#: Darts that are held at a time, about.
DARTS = 500_000
_SECOND_SEED = 0x3C6EF372FE94F82B
_RANK_BITS = np.uint64(40)
#: Chance of at most m darts in a unit cell.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 16.0)])))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, hash and row of each word, and each row's first word, and one more."""
    starts, ends, row = ragged.word_spans(data, offsets)
    return starts, ends, ragged.span_hashes(data, starts, ends), row, np.searchsorted(row, np.arange(len(offsets)))


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each row's words in their order."""
    starts, ends, word, row, first = _words(data, offsets)
    place, count, whole = (np.arange(len(word)) - first[row]).astype(np.uint64), np.diff(first).astype(np.uint64), []
    for hashes in (word, ragged.span_hashes(data, starts, ends, _SECOND_SEED)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ragged.mix(ragged.mix(hashes) + ragged.GOLD * (place + np.uint64(1))))])
        whole.append(ragged.mix(sums[first[1:]] - sums[first[:-1]] + count))
    return whole[0], whole[1]


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct shingle.

    A row of fewer than ``size`` words has one shingle of them all; one without words has none.
    """
    n = len(offsets) - 1
    _, _, word, _, first = _words(data, offsets)
    count = np.diff(first)
    windows = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    begin = ragged.ragged_index(first[:-1], windows)
    owner = np.repeat(np.arange(n), windows)
    length = np.minimum(count, size)[owner]
    total = np.zeros(len(begin), np.uint64)
    for k in range(size):
        here = k < length
        total[here] = ragged.mix(total[here] + word[begin[here] + k] + np.uint64(k + 1))
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    start = np.flatnonzero(new)
    return owner[start], total[start], np.diff(start, append=len(owner))


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, size: int = BANDS * BAND_ROWS) -> np.ndarray:
    """A signature of ``size`` coordinates for each row; rows without elements keep the largest value.

    A region is an element's weight by all ranks. Layer after layer of unit ranks,
    each unit cell holds a Poisson number of darts at hashed ranks; a dart beyond
    the element's weight doesn't count. About size * (ln(size) + 2) darts fill all
    coordinates; rows with empty ones get further layers.
    """
    best = np.full(rows * size, np.uint64(0xFFFFFFFFFFFFFFFF))
    mass = np.bincount(row, weight, rows)
    layers = np.maximum(1, np.ceil(size * (np.log(size) + 2) / np.maximum(mass, 1))).astype(np.int64)
    done = np.zeros(rows, np.int64)
    todo = mass > 0
    while todo.any():
        live = np.flatnonzero(todo[row])
        columns = np.ceil(weight[live]).astype(np.int64)
        cell = np.repeat(live, columns)
        column = ragged.ragged_index(np.zeros(len(live), np.int64), columns)
        deep = layers[row[cell]]
        layer = ragged.ragged_index(done[row[cell]], deep)
        cell, column = np.repeat(cell, deep), np.repeat(column, deep)
        seed = ragged.mix(element[cell] + ragged.GOLD * ((column.astype(np.uint64) << np.uint64(32)) + layer.astype(np.uint64) + np.uint64(1)))
        darts = np.searchsorted(_POISSON, seed.astype(np.float64) / 2.0**64, "right")
        hit = np.repeat(np.arange(len(cell)), darts)
        nth = ragged.ragged_index(np.zeros(len(cell), np.int64), darts).astype(np.uint64)
        dart = ragged.mix(seed[hit] + (nth + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        cell, column, layer = cell[hit], column[hit], layer[hit]
        whole = weight[cell] >= column + 1
        if not whole.all():
            inside = column + ragged.mix(dart + np.uint64(7)).astype(np.float64) / 2.0**64 < weight[cell]
            dart, cell, layer = dart[inside], cell[inside], layer[inside]
        rank = (layer.astype(np.uint64) << _RANK_BITS) | (dart >> np.uint64(24))
        coordinate = (ragged.mix(dart + np.uint64(3)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(best, row[cell] * size + coordinate, rank)
        done[todo] += layers[todo]
        todo &= (best.reshape(rows, size) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
    return best.reshape(rows, size)


def band_keys(signatures: np.ndarray, bands: int = BANDS, band_rows: int = BAND_ROWS) -> np.ndarray:
    """A bucket number for each row and band."""
    keys = np.zeros((len(signatures), bands), np.uint64)
    for k in range(band_rows):
        keys = ragged.mix(keys + signatures[:, k : bands * band_rows : band_rows] + np.uint64(k + 1))
    return ragged.mix(keys + ragged.GOLD * np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """Of ``docs`` (id, text): id, two hashes of the words, number of shingles, a bucket for each band, and a byte of each coordinate."""

    def run(batches):
        for batch in batches:
            _, offsets = ragged.text_bytes(batch.column(1))
            for i, j in ragged.row_slices(offsets, CHUNK_BYTES):
                whole = ragged.text_bytes(batch.column(1).slice(i, j - i))
                row, element, count = shingles(*whole)
                one, two = text_hashes(*whole)
                signatures = dart_signatures(row, element, count.astype(np.float64), j - i)
                keys, marks = band_keys(signatures), ragged.binary_column(list(signatures.astype(np.uint8)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                words = np.bincount(row, count, j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(words), lists, marks], ["id", "h1", "h2", "n_shingles", "buckets", "marks"])

    return docs.mapInArrow(run, "id long, h1 long, h2 long, n_shingles long, buckets array<long>, marks binary")


def hopeful(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose ``marks`` (id, marks) agree in enough coordinates to be alike."""

    def run(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            enough = pa.array((left == right).mean(axis=1) >= LEAST_AGREED) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(enough) for k in (0, 1)], ["a", "b"])

    left, right = (marks.select(F.col("id").alias(f"__{s}"), F.col("marks").alias(f"marks_{s}")) for s in "ab")
    both = pairs.join(left, F.col("a") == F.col("__a")).join(right, F.col("b") == F.col("__b")).select("a", "b", "marks_a", "marks_b")
    return both.mapInArrow(run, "a long, b long")


def similarities(data_a, offsets_a, data_b, offsets_b) -> np.ndarray:
    """Weighted Jaccard similarity of row i of one side and row i of the other; 0 where both are empty."""
    sides, n = [], len(offsets_a) - 1
    for data, offsets in ((data_a, offsets_a), (data_b, offsets_b)):
        row, element, count = shingles(data, offsets)
        sides.append((ragged.mix(element + ragged.GOLD * (row.astype(np.uint64) + np.uint64(1))), row, count))
    (key_a, row_a, count_a), (key_b, row_b, count_b) = sides
    _, at_a, at_b = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    common = np.bincount(row_a[at_a], np.minimum(count_a[at_a], count_b[at_b]), n)
    either = np.bincount(row_a, count_a, n) + np.bincount(row_b, count_b, n) - common
    return common / np.maximum(either, 1)


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (a, b) whose texts (id, text) are at least ``least`` alike."""

    def run(batches):
        for batch in batches:
            sizes = sum(ragged.text_bytes(batch.column(k))[1] for k in (2, 3))
            for i, j in ragged.row_slices(sizes, CHUNK_BYTES):
                alike = similarities(*ragged.text_bytes(batch.column(2).slice(i, j - i)), *ragged.text_bytes(batch.column(3).slice(i, j - i))) >= least
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i).filter(pa.array(alike)) for k in (0, 1)], ["a", "b"])

    left, right = (texts.select(F.col("id").alias(f"__{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")
    both = pairs.join(left, F.col("a") == F.col("__a")).join(right, F.col("b") == F.col("__b")).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest node (label) that each node (id) of the ``edges`` (a, b) reaches.

    Labels go to neighbours and then jump to the label's label, so long chains
    take a logarithmic number of rounds. Each round is written.
    """
    both = shared.written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = shared.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, F.col("id") == F.col("a")).select("id", "label", F.least("label", "near").alias("low"))
        target = labels.select(F.col("id").alias("__id"), F.col("label").alias("__label"))
        jumped = moved.join(target, F.col("low") == F.col("__id"), "left")
        new = shared.written(jumped.select("id", F.least("low", F.coalesce("__label", "low")).alias("label"), F.col("label").alias("before")), "labels")
        changed = new.where("label <> before").limit(1).count()
        shared.discard(labels)
        labels = new.select("id", "label")
        if not changed:
            shared.discard(both)
            return labels


def _sizes_allow(a, b):
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b) - 1e-6


def _each(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each shingle, its second, third .. copy in a row having a hash of its own; and each row's number of shingles."""
    row, element, count = shingles(data, offsets)
    nth = ragged.ragged_index(np.zeros(len(row), np.int64), count).astype(np.uint64)
    row, element = np.repeat(row, count), ragged.mix(np.repeat(element, count) + ragged.GOLD * nth)
    return row, element, np.bincount(row, minlength=len(offsets) - 1).astype(np.int64)


def _cell(element: np.ndarray) -> np.ndarray:
    return (element & np.uint64(CELLS - 1)).astype(np.int64)


def _shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many shingles of all ``texts`` fall into each cell: a fixed number of cells, so it can go to all tasks."""

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            for i, j in ragged.row_slices(ragged.text_bytes(column)[1], 4 * CHUNK_BYTES):
                _, element, _ = _each(*ragged.text_bytes(column.slice(i, j - i)))
                cells, counts = np.unique(_cell(element), return_counts=True)
                slices = cells // (CELLS // SLICES)
                parts = ragged.runs(slices)
                counts = np.minimum(counts, MOST_COUNT).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([int(slices[a]) for a, _ in parts], pa.int64()), *(ragged.binary_column([x[a:b] for a, b in parts]) for x in (cells.astype(np.uint32), counts))], ["slice", "cells", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total, first = np.zeros(CELLS // SLICES, np.int64), table["slice"][0].as_py()
        for cells, counts in zip(table["cells"].to_pylist(), table["counts"].to_pylist(), strict=True):
            total[np.frombuffer(cells, np.uint32) - first * (CELLS // SLICES)] += np.frombuffer(counts, np.uint16)
        return pa.table({"slice": [first], "counts": ragged.binary_column([np.minimum(total, MOST_COUNT).astype(np.uint16)])})

    # SLICES rows of 2 * CELLS / SLICES bytes come to the driver, whatever the number of texts.
    sums = texts.select("text").mapInArrow(run, "slice long, cells binary, counts binary").groupBy("slice").applyInArrow(summed, "slice long, counts binary")
    out = np.zeros(CELLS, np.uint16)
    for r in sums.collect():
        out[r["slice"] * (CELLS // SLICES) : (r["slice"] + 1) * (CELLS // SLICES)] = np.frombuffer(r["counts"], np.uint16)
    return out


def _rare_shingles(texts: DataFrame) -> DataFrame:
    """Of ``texts`` (id, text, label): (shingle, id, label, size, place, lead) for each text's rarest shingles; exact, two texts that are alike enough share one.

    Shingles are ordered by the count of their cell, then by hash; any one order for
    all texts gives whole results, a good one only saves work. Texts with similarity
    s or more share s of the larger one's shingles at least, so they share one of
    the first size - ceil(s * size) + 1 of each, and of the smaller one even of its
    first size - ceil(2 s / (1 + s) * size) + 1: there it leads. A passage that many
    texts have in common stands last in that order and brings nobody together. A
    shingle alone in its cell is in no other text and isn't sent.
    """
    counts = _shingle_counts(texts)

    def run(batches):
        for batch in batches:
            ids, labels, column = np.asarray(batch.column(0)), np.asarray(batch.column(2)), batch.column(1)
            for i, j in ragged.row_slices(ragged.text_bytes(column)[1], CHUNK_BYTES):
                row, element, size = _each(*ragged.text_bytes(column.slice(i, j - i)))
                count = counts[_cell(element)]
                order = np.lexsort((element, count, row))
                row, element, count = row[order], element[order], count[order]
                place = np.arange(len(row)) - np.searchsorted(row, np.arange(j - i))[row] + 1
                first, leads = (size - np.ceil(size * share - 1e-6).astype(np.int64) + 1 for share in (SIMILARITY, 2 * SIMILARITY / (1 + SIMILARITY)))
                sent = np.flatnonzero((place <= first[row]) & (count > 1))
                row, place = row[sent], place[sent]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (element[sent].view(np.int64), ids[i:j][row], labels[i:j][row], size[row], place.astype(np.int64), place <= leads[row])], ["shingle", "id", "label", "size", "place", "lead"])

    return texts.select("id", "text", "label").mapInArrow(run, "shingle long, id long, label long, size long, place long, lead boolean")


def sharper(texts: int) -> tuple[int, int]:
    """Bands, and coordinates in each, for so many texts: a doubling of the texts makes the bands one coordinate longer.

    Texts of half of the similarity that counts then meet as many others at any number of texts.
    """
    rows = max(8, math.ceil(math.log2(max(texts, 2))))
    return math.ceil(SHARP_MISS / SIMILARITY**rows), rows


def _sharp_buckets(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """Of ``texts`` (id, text, label, place): a row for each of so many bands of so many coordinates, with its bucket, id, label, number of shingles (size) and place.

    Texts are dealt evenly over the tasks first, since each costs many bands.
    """
    size = bands * rows
    most = max(1, int(DARTS / (size * (math.log(size) + 2))))

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            for first, last in ragged.row_slices(ragged.text_bytes(column)[1], CHUNK_BYTES):
                for i in range(first, last, most):
                    n = min(most, last - i)
                    row, element, count = shingles(*ragged.text_bytes(column.slice(i, n)))
                    keys = band_keys(dart_signatures(row, element, count.astype(np.float64), n, size), bands, rows)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.ravel()))
                    words = pa.array(np.bincount(row, count, n).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(2).slice(i, n), words, batch.column(3).slice(i, n), lists], ["id", "label", "size", "place", "buckets"])

    dealt = texts.select("id", "text", "label", "place").repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    signed = dealt.mapInArrow(run, "id long, label long, size long, place long, buckets array<long>")
    return signed.select(F.explode("buckets").alias("bucket"), "id", "label", "size", "place")


def _meeting_pairs(met: DataFrame, at: str, alike=None) -> DataFrame:
    """Pairs (a, b) of ``met`` (``at``, id, label, size, largest) of different classes: those outside the largest class at a place meet everyone of another class there."""
    outside = met.where("label <> largest").select(*(F.col(c).alias(f"__{c}") for c in met.columns))
    meet = (F.col(at) == F.col(f"__{at}")) & (F.col("label") != F.col("__label")) & _sizes_allow(F.col("size"), F.col("__size"))
    return met.join(outside, meet if alike is None else meet & alike).select(F.least("id", "__id").alias("a"), F.greatest("id", "__id").alias("b")).distinct()


def _mixed(rows: DataFrame, at: str) -> DataFrame:
    """Of ``rows`` (``at``, label), the places of more than one class: their number of rows (held) and their largest class."""
    by_class = rows.groupBy(at, "label").agg(F.count(F.lit(1)).alias("n"))
    return by_class.groupBy(F.col(at).alias("__at")).agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("held")).where("classes > 1").drop("classes")


def _crossing_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes among the ``texts`` (id, text, label) that may be alike enough: all that are, and few others.

    Alike texts share one of their rarest shingles. Where it is in ``FEW`` texts at
    most, these meet in pairs. Texts that have a rarest shingle that more of them
    have meet by longer bands, so a passage or sentence of many texts brings no crowd together.
    """
    sent = shared.written(_rare_shingles(texts), "rare-shingles")
    mixed = shared.written(sent.join(_mixed(sent, "shingle"), F.col("shingle") == F.col("__at")).drop("__at"), "mixed-shingles")
    # What two texts can still have in common from their first common shingle on must do for the similarity.
    enough = 1 + F.least(F.col("size") - F.col("place"), F.col("__size") - F.col("__place")) >= SIMILARITY / (1 + SIMILARITY) * (F.col("size") + F.col("__size")) - 1e-6
    leads = (F.col("lead") & (F.col("size") <= F.col("__size"))) | (F.col("__lead") & (F.col("__size") <= F.col("size")))
    few = _meeting_pairs(mixed.where(F.col("held") <= FEW), "shingle", leads & enough)
    # Those whose first common shingle many have: it stands at ``place`` or behind.
    crowd = shared.written(mixed.where(F.col("held") > FEW).groupBy(F.col("id").alias("__id")).agg(F.min("place").alias("place")), "crowd")
    sharp = shared.written(_sharp_buckets(texts.join(crowd, F.col("id") == F.col("__id")), *sharper(crowd.count())), "sharp")
    met = shared.written(sharp.join(_mixed(sharp, "bucket"), F.col("bucket") == F.col("__at")).drop("__at", "held"), "met-again")
    pairs = shared.written(few.union(_meeting_pairs(met, "bucket", enough)).distinct(), "crossing")
    shared.discard(sent, mixed, crowd, sharp, met)
    return pairs


def duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's class: key, class_id (the smallest key of its class), class_size, n_links.

    Two documents are linked if the weighted Jaccard similarity of their word
    5-grams is 0.8 or more; classes are what links connect. Documents of fewer than
    five words are alike only if their words are equal. Null, empty and wordless
    texts are classes of their own. A row without a key has no class (null), size 1
    and no link. Keys are whole numbers (others end in Spark's cast error). Rows
    with one key are one document, alike to what any of its texts is alike to.
    n_links counts the verified links from a document's text to other texts that
    hold its class together; pairs known to be in one class aren't compared, and
    equal texts aren't links. One row for each input row; other columns aren't read.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    keyed = source.where("id IS NOT NULL")
    sketch = shared.written(sketches(keyed), "sketches")
    # Equal texts have equal buckets.
    copies = shared.written(sketch.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("size"), F.first("buckets").alias("buckets"), F.first("marks").alias("marks")), "copies")
    slim = shared.written(sketch.select("id", "h1", "h2"), "hashes")
    shared.discard(sketch)
    dealt = copies.select(F.explode("buckets").alias("bucket"), F.col("rep").alias("id"), "size")
    crowded = shared.written(dealt.groupBy(F.col("bucket").alias("__bucket")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowded")
    met = shared.written(dealt.join(crowded, F.col("bucket") == F.col("__bucket")).select("bucket", "id", "size", "n"), "met")
    # An original meets its copies more often than they meet each other, so it is the best centre.
    mates = met.groupBy(F.col("id").alias("__id")).agg(F.sum(F.col("n") - 1).alias("mates"))
    members = shared.written(met.join(mates, F.col("id") == F.col("__id")).select("bucket", "id", "size", "mates"), "members")
    best = F.struct("mates", -F.col("id"))
    centre = members.groupBy(F.col("bucket").alias("__bucket")).agg(F.max_by("id", best).alias("centre"), F.max_by("size", best).alias("centre_size"))
    involved = members.select(F.col("id").alias("__id")).distinct().hint("merge")  # they grow with the documents: not to be broadcast
    texts = shared.written(keyed.join(involved, F.col("id") == F.col("__id"), "left_semi"), "texts")
    marks = copies.select(F.col("rep").alias("id"), "marks")

    starred = members.join(centre, F.col("bucket") == F.col("__bucket")).where(F.col("id") != F.col("centre"))
    pairs = shared.written(starred.where(_sizes_allow(F.col("size"), F.col("centre_size"))).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "pairs")
    links = shared.written(verified(hopeful(pairs, marks), texts), "links")
    labels = components(links)

    # All have been compared with their bucket's centre; what is left are pairs of the others that are of different classes.
    label = F.coalesce("label", "id")
    classed = starred.join(labels.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").select("bucket", "id", label.alias("label"))
    open_buckets = classed.groupBy(F.col("bucket").alias("__bucket")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    unsettled = shared.written(classed.join(open_buckets, F.col("bucket") == F.col("__bucket"), "left_semi").select(F.col("id").alias("__id"), "label").distinct(), "unsettled")
    crossing = _crossing_pairs(texts.join(unsettled, F.col("id") == F.col("__id")).select("id", "text", "label"))
    more = shared.written(verified(hopeful(crossing.join(pairs, ["a", "b"], "left_anti"), marks), texts), "links")
    if not more.isEmpty():
        first, labels = labels, components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).where("a <> b").union(more))
        shared.discard(first)

    ends = links.union(more)
    n_links = ends.select(F.col("a").alias("__rep")).union(ends.select("b")).groupBy("__rep").agg(F.count(F.lit(1)).alias("n_links"))
    class_of = labels.select(F.col("id").alias("__id"), F.col("label").alias("__label"))
    named = copies.join(class_of, F.col("rep") == F.col("__id"), "left").join(n_links, F.col("rep") == F.col("__rep"), "left")
    named = named.select(F.col("h1").alias("__1"), F.col("h2").alias("__2"), F.coalesce("__label", "rep").alias("class_id"), "n", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    sizes = named.groupBy(F.col("class_id").alias("__class")).agg(F.sum("n").alias("class_size"))
    groups = shared.written(named.join(sizes, F.col("class_id") == F.col("__class")).select("__1", "__2", "class_id", "class_size", "n_links"), "groups")
    shared.discard(copies, crowded, met, members, texts, pairs, links, unsettled, crossing, more, labels)
    out = slim.join(groups, (F.col("h1") == F.col("__1")) & (F.col("h2") == F.col("__2")), "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    known = out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", one).alias("class_size"), F.coalesce("n_links", none).alias("n_links"))
    return known.union(source.where("id IS NULL").select(F.col("id").alias(key), F.col("id").alias("class_id"), one.alias("class_size"), none.alias("n_links")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest key of each class; rows without a key stay, and all columns."""
    classes = duplicate_classes(docs, key, text)
    gone = shared.written(classes.where(F.col(key) != F.col("class_id")).select(F.col(key).alias("__sf_gone")).distinct(), "duplicates")
    return docs.join(gone, F.col(key) == F.col("__sf_gone"), "left_anti")
