"""Approximate nearest neighbours by cosine from sharded, robust-pruned directed graphs.

Equal vectors are collapsed to one with its smallest ids. Distinct vectors of one
length are dealt to shards by a hash. A shard holds at least ``SHARD_ROWS`` rows, or
``SHARD_ROOT`` times the square root of all, up to ``MOST_SHARD_ROWS``, so that
there are fewer shards to search as rows grow. In each shard vectors enter a
graph in growing batches: greedy beam searches from the middle and some others propose
neighbours, relaxed distance pruning keeps at most ``DEGREE`` of them in different
directions, and the same pruning trims nodes that gain too many incoming edges.
Beam search then answers every query in each shard, block after block, the scores
are computed anew in double precision on the original vectors, and each query keeps
its best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreframe.llm import ragged, shared

SHARD_ROWS, SHARD_ROOT, MOST_SHARD_ROWS = 8192, 36, 1 << 16
#: Edges of a node, width of the beams that build and that search, and the relaxation of the pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 24, 48, 192, 1.2
#: Nodes where each search begins: a dense group of near-equal vectors has few edges out, so one entry could be caught in it.
ENTRIES = 32
BATCH = 512


class PrunedGraph:
    """A directed graph over unit vectors, built by batches of greedy searches and robust pruning."""

    def __init__(self, units: np.ndarray):
        self.x = units.astype(np.float32)
        n = len(units)
        self.edges = np.full((n, DEGREE), -1, np.int32)
        middle = int(np.argmax(self.x @ self.x.mean(axis=0)))
        order = np.random.default_rng(7).permutation(n)
        order = np.concatenate([[middle], order[order != middle]])
        done, self.entries = 1, order[:1]
        while done < n:
            batch = order[done : done + min(max(1, done), BATCH)]
            self.entries = order[: min(done, ENTRIES)]
            beam, _ = self.search(self.x[batch], BUILD_BEAM)
            beam[beam == batch[:, None]] = -1
            self.edges[batch] = self.prune(batch, beam)
            self._link_back(batch)
            done += len(batch)

    def distance(self, to: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances from vectors ``to`` to their rows of ``nodes``; infinite for -1."""
        apart = self.x[nodes]
        apart -= to[:, None, :]
        return np.where(nodes >= 0, np.einsum("qcd,qcd->qc", apart, apart), np.inf)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes that greedy search finds for each query, nearest first; -1 where there are fewer."""
        q = len(queries)
        rows = np.arange(q)
        ids = np.full((q, width), -1, np.int64)
        e = len(self.entries)
        ids[:, :e] = self.entries
        far = np.full((q, width), np.inf)
        far[:, :e] = self.distance(queries, ids[:, :e])
        opened = np.zeros((q, width), bool)
        seen = np.zeros((q, len(self.x) + 1), bool)
        seen[:, self.entries] = seen[:, -1] = True
        while True:
            waiting = np.where(opened, np.inf, far)
            at = waiting.argmin(axis=1)
            live = np.flatnonzero(waiting[rows, at] < np.inf)
            if not len(live):
                return ids, far
            opened[live, at[live]] = True
            near = self.edges[ids[live, at[live]]].astype(np.int64)
            near[seen[live[:, None], near]] = -1
            seen[live[:, None], near] = True
            d = self.distance(queries[live], near)
            all_ids, all_far = np.concatenate([ids[live], near], axis=1), np.concatenate([far[live], d], axis=1)
            all_open = np.concatenate([opened[live], np.zeros(near.shape, bool)], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            ids[live], far[live], opened[live] = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_far, all_open))

    def prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """At most DEGREE of each node's ``candidates`` (-1: none): the nearest, then those not much nearer to one kept than to the node."""
        kept = np.full((len(nodes), DEGREE), -1, np.int32)
        far = self.distance(self.x[nodes], candidates)
        rows = np.arange(len(nodes))
        for k in range(DEGREE):
            at = far.argmin(axis=1)
            some = far[rows, at] < np.inf
            if not some.any():
                break
            chosen = np.where(some, candidates[rows, at], -1)
            kept[:, k] = chosen
            across = self.distance(self.x[chosen], candidates)
            far[some[:, None] & (RELAX**2 * across <= far)] = np.inf
            far[rows, at] = np.inf
        return kept

    def _link_back(self, batch: np.ndarray) -> None:
        """Edges back from the neighbours of ``batch``; nodes with too many are pruned."""
        source, target = np.repeat(batch, DEGREE), self.edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0].astype(np.int64)
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        start = ragged.run_starts(target)
        nodes, gained = target[start], np.diff(start, append=len(target))
        by_size = np.argsort(gained, kind="stable")
        for part in np.array_split(by_size, max(1, -(-len(by_size) // BATCH))):
            if not len(part):
                continue
            wide = int(gained[part].max())
            fresh = np.full((len(part), wide), -1, np.int64)
            place = ragged.ragged_index(np.zeros(len(part), np.int64), gained[part])
            fresh[np.repeat(np.arange(len(part)), gained[part]), place] = source[ragged.ragged_index(start[part], gained[part])]
            own = self.edges[nodes[part]].astype(np.int64)
            fresh[(fresh[:, :, None] == own[:, None, :]).any(axis=2)] = -1
            both = np.concatenate([own, fresh], axis=1)
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
            full = (packed >= 0).sum(axis=1) > DEGREE
            self.edges[nodes[part][~full]] = packed[~full, :DEGREE]
            if full.any():
                self.edges[nodes[part][full]] = self.prune(nodes[part][full], packed[full])


def _valid(vector: str):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _shards(distinct: DataFrame, shard_rows: int | None) -> DataFrame:
    """For each length of vectors: its first shard and how many it has."""
    lengths = distinct.groupBy(F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    grown = F.least(F.lit(MOST_SHARD_ROWS), F.greatest(F.lit(SHARD_ROWS), F.ceil(SHARD_ROOT * F.sqrt(F.col("n").cast("double")))))
    rows = grown if shard_rows is None else F.lit(shard_rows)
    counted = lengths.withColumn("shards", F.ceil(F.col("n") / rows).cast("long"))
    before = F.sum("shards").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1))  # a row a length
    return counted.select("length", "shards", F.coalesce(before, F.lit(0)).alias("first"))


_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("score", T.DoubleType())])


class _Shard:
    """One shard's points and their graph."""

    def __init__(self, points: pa.Table):
        # Rows come in any order; sorting makes reruns agree.
        points = points.take(np.argsort(np.array([i[0] for i in points["ids"].to_pylist()]), kind="stable"))
        self.ids = points["ids"].to_pylist()
        self.x = self._matrix(points)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.graph = PrunedGraph(self.x / self.norm[:, None])

    @staticmethod
    def _matrix(rows: pa.Table) -> np.ndarray:
        """The vectors, each by a power of two so that its largest component is between 0.5 and 1: cosines stay, and no square overflows or vanishes."""
        x = pc.list_flatten(rows["v"]).to_numpy().reshape(len(rows), -1)
        return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])

    def answers(self, asks: pa.Table, k: int) -> pa.RecordBatch:
        q, names, out = self._matrix(asks), asks["query"].to_pylist(), ([], [], [])
        q_norm = np.sqrt((q * q).sum(axis=1))
        found, _ = self.graph.search((q / q_norm[:, None]).astype(np.float32), SEARCH_BEAM)
        exact = np.where(found >= 0, np.einsum("qcd,qd->qc", self.x[found], q) / (self.norm[found] * q_norm[:, None]), -np.inf)
        for ask, near, scores in zip(names, found, exact, strict=True):
            best = np.lexsort((np.array([self.ids[p][0] if p >= 0 else 0 for p in near]), -scores))[: k + 1]
            listed = sorted(((-scores[c], i) for c in best if near[c] >= 0 for i in self.ids[near[c]] if i != ask))[:k]
            for column, values in zip(out, ([ask] * len(listed), [i for _, i in listed], [-s for s, _ in listed]), strict=True):
                column += values
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], _FOUND.names)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_rows: int | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each of the ``queries``: query_id, rank, key, score.

    Both tables have an integer key (others end in Spark's cast error) and a vector.
    A candidate with the query's own key is left out, as are vectors of another
    length than the query's. Nearest first, by cosine, ties to the smaller key.
    Vectors null, empty, zero, or with a null or non-finite component take no part,
    nor do rows without a key; rows with one key and one vector count once. Fewer
    candidates than ``k`` are all returned; an empty table gives no rows. Components
    may be of any size that a double has. Other columns aren't read. ``shard_rows`` sets the rows of a shard.
    """
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _valid("v"))
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _valid("v")).distinct()
    # Ties go to smaller keys, so of equal vectors only the k + 1 smallest keys can be an answer.
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = good.distinct().withColumn("nth", first).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = shared.written(distinct, "distinct-vectors")
    shards = shared.written(_shards(distinct, shard_rows), "shards")
    total = shards.agg(F.sum("shards")).first()[0] or 0
    of = F.size("v") == F.col("length")
    dealt = distinct.join(shards, of).select((F.col("first") + F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.col("shards"))).alias("shard"), F.lit(None).cast("long").alias("query"), "ids", "v")
    sent = asked.join(shards, of).select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)).alias("shard"), F.col("id").alias("query"), F.array().cast("array<long>").alias("ids"), "v")

    def run(batches):
        points, shard = [], None
        for batch in batches:
            is_query = np.asarray(batch.column(0).is_valid())
            if not is_query.all():
                points.append(batch.filter(pa.array(~is_query)))
            asks = pa.Table.from_batches([batch.filter(pa.array(is_query))])
            if len(asks) and points:
                shard = shard or _Shard(pa.Table.from_batches(points))
                for a in range(0, len(asks), BATCH):
                    yield shard.answers(asks.slice(a, BATCH), k)

    # A partition is a shard: its points come first, then the queries pass through block by block.
    parts = dealt.union(sent).repartitionById(max(1, total), F.col("shard").cast("int")).sortWithinPartitions(F.col("query").asc_nulls_first())
    found = parts.select("query", "ids", "v").mapInArrow(run, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
