"""Reading and writing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreframe.sources.stored import clustered


def table(spark: SparkSession, folder: str, name: str, tolerant: bool = False) -> DataFrame:
    """A Parquet table; ``tolerant`` skips corrupt and missing files and merges schemas."""
    reader = spark.read
    if tolerant:
        reader = reader.options(ignoreCorruptFiles="true", ignoreMissingFiles="true", mergeSchema="true")
    return reader.parquet(f"{folder}/{name}.parquet")


def selected(source: DataFrame, columns: list[str], **equal) -> DataFrame:
    """Rows with the given values, and the given columns; both reach the scan."""
    for name, value in equal.items():
        source = source.where(F.col(name) == value)
    return source.select(*columns)


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows of all tables by column name; columns missing somewhere are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_results(results: DataFrame, path: str, partition: str | None = None) -> None:
    """The result table as Parquet; with ``partition``, in a folder a value of that column.

    Only the folders of values that ``results`` has are replaced, all at the end of
    the job: the others keep their files, a rerun leaves one copy, and a job or task
    that fails leaves what was there. Rows of a folder are gathered into few files,
    a large folder's over several tasks. Without ``partition`` the whole table is replaced.
    """
    if partition is None:
        results.write.mode("overwrite").parquet(path)
    else:
        clustered(results, [partition]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def candidates_from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Inline candidate rows with the fixed schema; absent fields are null."""
    schema = (
        "player string, position string, style string, efficiency string, probability double, shots int, xg_total double, "
        "age int, market_value int, contract_years_left int, salary int, injury_risk string"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
