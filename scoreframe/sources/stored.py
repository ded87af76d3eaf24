"""Tables written once for each version of their inputs and read again by every query that needs them.

A stored table is named by what it holds and by the version of its input files, and
is entered into the session's catalog only after it is written, so a job that fails
leaves no table behind and a lost executor only repeats its tasks. Its files go to
the folder that ``spark.checkpoint.dir`` names; only where that is unset and Spark is
local is a temporary folder of this machine used. A cluster that names no folder
stores nothing: the rows are made for each query.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def version(spark: SparkSession, *paths: str) -> str:
    """A name for the present state of the files under ``paths``: it changes when one comes, goes, grows or is written anew.

    Reads one row a file, none of their contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length", "modificationTime")
    said = files.agg(F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0)).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return f"{said['h'] & 0xFFFFFFFFFFFFFFFF:016x}_{said['n']}"


def _location(spark: SparkSession, name: str) -> str | None:
    """A new folder that the driver and all executors share; none, if a cluster names none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder and re.match(r"local(\[|$)", spark.sparkContext.master):
        folder = "file://" + tempfile.mkdtemp(prefix="scoreframe-")
    return folder and f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def clustered(rows: DataFrame, partition: Sequence[str]) -> DataFrame:
    """``rows`` with those of a partition side by side, in few files; a partition of many rows is split over tasks at run time."""
    return rows.hint("rebalance", *(F.col(c) for c in partition)).sortWithinPartitions(*partition)


def stored(spark: SparkSession, name: str, of: str, make: Callable[[], DataFrame], partition: Sequence[str] = (), buckets: tuple[int, str] | None = None) -> DataFrame:
    """The table ``name`` of version ``of``; ``make`` is asked for its rows only if it isn't there yet.

    ``partition`` gives folders by value, for scans that read some of them;
    ``buckets`` (number, column) gives files by hash, for joins on that column
    without a shuffle of this side. If two sessions of one catalog write at once, the first one's table stays.
    """
    table = f"scoreframe_{name}_{of}"
    if not spark.catalog.tableExists(table):
        rows, place = make(), _location(spark, table)
        if place is None:
            return rows
        # Rows of a bucket come together before they are written, so there are few files; a hot one's are split over tasks.
        writer = (clustered(rows, partition) if partition else rows.hint("rebalance", F.col(buckets[1])) if buckets else rows).write
        if partition:
            writer = writer.partitionBy(*partition)
        if buckets:
            writer = writer.bucketBy(buckets[0], buckets[1]).sortBy(buckets[1])
        try:
            writer.option("path", place).format("parquet").saveAsTable(table)
        except AnalysisException as failed:
            if failed.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
                raise
    return spark.table(table)


def forget(spark: SparkSession, name: str, of: str) -> None:
    """Takes a stored table out of the catalog; the next query that needs it writes it anew."""
    spark.sql(f"DROP TABLE IF EXISTS `scoreframe_{name}_{of}`")
