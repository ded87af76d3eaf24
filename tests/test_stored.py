"""Stored tables: versions, reuse, partitions, buckets, and results written twice."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scoreframe.operators import events
from scoreframe.plans import boards, catalog
from scoreframe.sources import stored, tables

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_versions_follow_the_files(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(5).write.parquet(path)
    first = stored.version(spark, path)
    assert first == stored.version(spark, path)
    spark.range(5).write.mode("append").parquet(path)
    assert stored.version(spark, path) != first


def test_made_once_a_version(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(10)

    for of in ("a", "a", "b"):
        assert stored.stored(spark, "once", of, make).count() == 10
    assert len(made) == 2
    stored.forget(spark, "once", "a")
    assert stored.stored(spark, "once", "a", make).count() == 10 and len(made) == 3
    for of in "ab":
        stored.forget(spark, "once", of)


def test_failed_write_leaves_no_table(spark):
    bad = lambda: spark.range(3).select(F.raise_error(F.lit("lost")).alias("x").cast("int"))
    with pytest.raises(Exception, match="lost"):
        stored.stored(spark, "failed", "v", bad)
    assert stored.stored(spark, "failed", "v", lambda: spark.range(3)).count() == 3
    stored.forget(spark, "failed", "v")


def test_requests_scan_the_events_at_most_once(spark):
    """The ranked table is read; events are scanned when it is written, and not again."""
    boards.ranked_players(spark, DATA)
    for name in ("request_board", "request_recommend", "request_relax", "topk_reuse", "pair_compare_all", "rank_by_profit", "recommend_top1", "first_n"):
        said = plan(catalog.QUERIES[name](spark, DATA))
        assert "events.parquet" not in said and "ranked_players" in said and "Window" not in said, name
    assert "PushedFilters: [IsNotNull(rank), LessThanOrEqual(rank,3)]" in catalog.QUERIES["topk_reuse"](spark, DATA)._jdf.queryExecution().toString().replace("\n", "") or "LessThanOrEqual(rank,3)" in plan(catalog.QUERIES["topk_reuse"](spark, DATA))


def test_seasons_are_pruned(spark):
    """A season's scan and a join with a few seasons both read the folders of these seasons only."""
    found = catalog.QUERIES["season_matches"](spark, DATA)
    assert "PartitionFilters: [isnotnull(season" in plan(found) and found.count()
    matches = boards.stored_matches(spark, DATA)
    files = matches.where("season = 1997").select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("season=1997" in r["f"] for r in files)
    chosen = spark.createDataFrame([(1995, "x"), (1996, "y")], "season int, why string").where("why = 'y'")
    assert "dynamicpruning" in plan(matches.join(F.broadcast(chosen), "season"))


def test_stored_events_are_not_moved(spark):
    log = boards.stored_match_events(spark, DATA)
    wanted = spark.range(400).select((F.col("id") * 7).alias("match_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = events.in_matches(log, wanted)
        assert plan(found).count("Exchange") == 1  # of the list
        assert len({r["f"] for r in log.select(F.input_file_name().alias("f")).distinct().collect()}) <= 8
        assert found.count() == log.where("match_id % 7 = 0 AND match_id < 2800").count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_results_written_again(spark, tmp_path):
    """One scenario is replaced: the others keep their files, a rerun leaves one copy, a failed job changes nothing."""
    path = f"{tmp_path}/t.parquet"
    rows = spark.range(3000).select(F.col("id").alias("player"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("scenario"))
    tables.write_results(rows, path, "scenario")
    files = lambda: {str(p): os.stat(p).st_mtime_ns for p in Path(path).rglob("*.parquet")}
    first = files()
    one = rows.where("scenario = 's1'").withColumn("player", -F.col("player"))
    for _ in range(2):
        tables.write_results(one, path, "scenario")
        after = files()
        assert {p: t for p, t in after.items() if "scenario=s1" not in p} == {p: t for p, t in first.items() if "scenario=s1" not in p}
        got = spark.read.parquet(path)
        assert got.count() == 3000 and got.where("scenario = 's1' AND player > 0").count() == 0
    with pytest.raises(Exception, match="lost"):
        tables.write_results(one.withColumn("player", F.when(F.col("player") < -500, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("player"))), path, "scenario")
    assert files() == after
    assert len([p for p in first if "scenario=s0" in p]) == 1
