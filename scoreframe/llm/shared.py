"""Tables written to the cluster's shared folder, in place of long lineages.

A written table survives the loss of any executor. The folder is the one that
``spark.checkpoint.dir`` names; only where that is unset and Spark is local (tests,
a laptop) is a temporary folder of this machine used.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="scoreframe-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_MADE: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[list]:
    """Collects the tables written inside it; on leaving, all but the last are deleted."""
    token = _MADE.set([])
    try:
        yield _MADE.get()
        discard(*_MADE.get()[:-1])
    finally:
        _MADE.reset(token)


#: With it on, Spark deletes a query's shuffle files as soon as the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it as read from there.

    The shuffle files of the write aren't needed again, so they go at its end.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
