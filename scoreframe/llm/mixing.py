"""Sources mixed to target weights by systematic sampling, with DataFrame functions only.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and
share the words of all documents; a target stops at ``MOST_COPIES`` times its
source's words and the excess goes to the others by weight. That is one level L
with target = min(weight * L, cap), found by running sums over one row a source.

Sampling: every document of a source expects target / source words copies. The
running sum of these within the source, plus one offset, crosses integers; a
document is taken once for each integer crossed. So that no source's documents
meet in one task, a source is dealt into about sqrt(documents) / 3 strata by a hash
of the document id; strata follow one another, and within a stratum documents
stand by size, rising and falling in turn, so each size is taken in its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.llm import shared

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Offsets are odd multiples of 1 / (2 * OFFSETS), so that sums of whole copies stay exact.
OFFSETS = 1024


def word_count(text: Column) -> Column:
    """Number of runs of other bytes than 0x20 and 0x09 to 0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(value: Column, buckets: Column) -> Column:
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % buckets


def source_targets(sized: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """A row a source: its number, words, rows, target, copies a document expects, and random offset.

    The running sums go over one row a source in one task: meant for up to some millions of sources.
    """
    totals = sized.groupBy(F.col(source).alias("__source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    everything = Window.partitionBy(F.lit(0))
    numbered = totals.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = numbered.withColumns({"weight": weight, "cap": F.lit(float(most)) * F.col("source_size"), "total": F.sum("source_size").over(everything).cast("double")})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = capped.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    target = F.least(F.col("weight") * F.max(fits).over(everything), F.col("cap"))
    return leveled.withColumn("target", target).select(
        "__source", "source_no", "source_size", "n_rows", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        ((_hash(F.coalesce("__source", F.lit("")), F.lit(OFFSETS)) + 0.5) / OFFSETS).alias("offset"),
        F.ceil(F.sqrt(F.col("n_rows").cast("double")) / 3).cast("long").alias("strata"),
    )


#: Names of the columns that the plan works with, apart from those of the caller's table.
_SIZE, _TIE = "__sf_size", "__sf_tie"
_PLAN = ("source_size", "target", "copies", "taken")


def sized(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Key, source, size and a hash of the text of each row, written: two passes over it need no text."""
    return shared.written(docs.select(key, source, word_count(F.col(text)).alias(_SIZE), F.xxhash64(text).alias(_TIE)), "sizes")


def planned(docs: DataFrame, sizes: DataFrame, key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` with __sf_source_size, __sf_target, __sf_copies and __sf_taken (size times copies).

    Both tables are of the same rows and have the columns of :func:`sized`;
    ``sizes`` is read twice and should be cheap to read. No row is lost. Rows with
    equal keys are rows like others, in the order of their size and text; rows
    without a key are dealt by their text; a null source is a source. A source
    without words has target 0. An empty table stays empty.
    """
    targets = source_targets(sizes, source, _SIZE, weights, most)
    targets = shared.written(targets.select(*(F.col(c).alias("__sf_" + c.strip("_")) for c in targets.columns)), "targets")
    # Rows without a key stand in the strata of their texts, so that they don't meet in one task.
    stratum = _hash(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), F.col(_TIE).cast("string"))), F.col("__sf_strata"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(targets, rows[source].eqNullSafe(targets["__sf_source"])).withColumn("__sf_stratum", stratum)

    counts = dealt(sizes).groupBy("__sf_source_no", "__sf_stratum").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__sf_source_no").orderBy("__sf_stratum").rowsBetween(Window.unboundedPreceding, -1)
    starts = shared.written(counts.select(F.col("__sf_source_no").alias("__sf_no"), F.col("__sf_stratum").alias("__sf_of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__sf_start")), "strata")
    within = Window.partitionBy("__sf_source_no", "__sf_stratum").orderBy(F.when(F.col("__sf_stratum") % 2 == 0, F.col(_SIZE)).otherwise(-F.col(_SIZE)), F.col(key).asc_nulls_last(), _TIE)
    ranked = dealt(docs).withColumn("__sf_rank", F.row_number().over(within))
    placed = ranked.join(starts, (F.col("__sf_source_no") == F.col("__sf_no")) & (F.col("__sf_stratum") == F.col("__sf_of")))
    place, offset, rate = F.col("__sf_start") + F.col("__sf_rank"), F.col("__sf_offset"), F.col("__sf_rate")
    crossed = F.floor(offset + rate * place) - F.floor(offset + rate * (place - 1))
    copies = F.least(crossed, F.lit(most)).cast("long")
    return placed.withColumns({"__sf_copies": copies, "__sf_taken": copies * F.col(_SIZE)}).select(*docs.columns, *(f"__sf_{c}" for c in _PLAN))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs`` as they are."""
    plan = planned(docs.withColumns({_SIZE: word_count(F.col(text)), _TIE: F.xxhash64(text)}), sized(docs, key, source, text), key, source)
    return plan.where("__sf_copies > 0").withColumn("__sf_copy", F.explode(F.sequence(F.lit(1), F.col("__sf_copies").cast("int")))).select(*docs.columns)


def mixing_report(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Each document's key, source, size, source words and target, copies, and words taken. Other columns aren't read."""
    sizes = sized(docs, key, source, text)
    return planned(sizes, sizes, key, source).select(key, source, F.col(_SIZE).alias("size"), *(F.col(f"__sf_{c}").alias(c) for c in _PLAN))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         3.0::DOUBLE * source_size AS cap, (SELECT sum(size) FROM sized)::DOUBLE AS total FROM totals
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), targets AS (
  SELECT *, least(weight * (SELECT max(level) FROM levels WHERE level <= cap / weight), cap) AS target,
         (coalesce(('0x' || substr(md5(coalesce(source, '')), 1, 15))::BIGINT % 1024, 0) + 0.5::DOUBLE) / 1024 AS off,
         ceil(sqrt(n_rows::DOUBLE) / 3)::BIGINT AS strata FROM levels
), dealt AS (
  SELECT d.doc_id, d.size, d.source, t.source_size, t.target, t.off, t.source_no,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         coalesce(('0x' || substr(md5(d.doc_id::VARCHAR), 1, 15))::BIGINT % t.strata, 0) AS stratum
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY stratum, CASE WHEN stratum % 2 = 0 THEN size ELSE -size END, doc_id NULLS LAST) AS place FROM dealt
), taken AS (
  SELECT *, least(floor(off + rate * place) - floor(off + rate * (place - 1)), 3)::BIGINT AS copies FROM placed
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM taken
"""
