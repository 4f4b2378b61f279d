"""Keyed append tables: the stored side is neither moved nor sorted for small batches."""

import re

from pyspark.sql import functions as F

from quire.operators import keyed
from quire.streaming import jobs

KEY = ["path", "page_id"]


def frame(spark, lo, hi, text="t"):
    return spark.range(lo, hi).select(F.concat(F.lit("p"), F.col("id") % 97).alias("path"), F.col("id").cast("string").alias("page_id"),
                                      F.lit(text).alias("text"), F.lit(0).alias("ord"))


def stored_side(df):
    """The plan's part below the join that reads the stored keys."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "Bucketed: true" in x or "quire_keyed" in x or re.search(r"FileScan parquet.*quire_keyed", x))
    depth = len(re.match(r"[^A-Za-z*]*", lines[at]).group())
    above = []
    for x in reversed(lines[:at]):
        d = len(re.match(r"[^A-Za-z*]*", x).group())
        if d < depth:
            above.append(x.strip(" +-:*()0123456789"))
            depth = d
    return above, lines[at]


def test_append_once_per_key(spark, scratch):
    path = f"{scratch}/t"
    assert keyed.append(frame(spark, 0, 3000), path, KEY, ["ord"], buckets=16) == 3000
    for small in (10_000_000, 0):
        keyed.append(frame(spark, 2000, 4000, "later").unionByName(frame(spark, 2000, 2010, "again")), path, KEY, ["ord", "text"], small_rows=small)
    got = spark.read.parquet(path)
    assert got.count() == 4000 == got.select(*KEY).distinct().count()
    assert got.filter("text = 't'").count() == 3000 and got.filter("text = 'again'").count() == 0
    nulls = spark.createDataFrame([(None, "1", "x", 0)], "path string, page_id string, text string, ord int")
    keyed.append(nulls, path, KEY, ["ord"])
    assert keyed.table(spark, path).count() == 4000


def test_stored_keys_are_not_shuffled(spark, scratch):
    path = f"{scratch}/t"
    keyed.append(frame(spark, 0, 3000), path, KEY, ["ord"], buckets=16)
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # a large batch meets the buckets as they lie
        large = keyed.rows_to_append(frame(spark, 1000, 5000), path, KEY, ["ord"], small=False)
        above, scan = stored_side(large)
        join = next(i for i, x in enumerate(above) if "Join" in x)
        assert "Bucketed: true" in scan and not any("Exchange" in x for x in above[:join])
        assert large.count() == 2000
        # a small one comes to them: no sort either
        small = keyed.rows_to_append(frame(spark, 2990, 3010), path, KEY, ["ord"], small=True)
        above, scan = stored_side(small)
        join = next(i for i, x in enumerate(above) if "Join" in x)
        assert "Broadcast" in above[join] and not any("Exchange" in x or "Sort" in x for x in above[:join])
        assert small.count() == 10
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)


def test_another_session_reads_the_same_layout(spark, scratch):
    path = f"{scratch}/t"
    keyed.append(frame(spark, 0, 500), path, KEY, ["ord"], buckets=4)
    spark.sql(f"DROP TABLE {keyed._name(spark, path)}")      # what a new session's catalog holds: nothing
    keyed.append(frame(spark, 0, 600), path, KEY, ["ord"])
    assert keyed.table(spark, path).count() == 600 and keyed._meta(spark, path)["buckets"] == 4
    keyed.rebucket(spark, path, f"{scratch}/wide", 9)
    assert keyed.table(spark, f"{scratch}/wide").count() == 600
    keyed.append(frame(spark, 550, 700), f"{scratch}/wide", KEY, ["ord"])
    assert keyed.table(spark, f"{scratch}/wide").count() == 700
    assert keyed.buckets_for(1) == 1 and keyed.buckets_for(10 ** 12) == keyed.MAX_BUCKETS


def test_bucketed_sink_is_exactly_once(spark, scratch):
    land, path = f"{scratch}/land", f"{scratch}/t"
    for i in range(3):
        frame(spark, 100 * i, 100 * i + 150).coalesce(1).write.parquet(f"{land}/b{i}")
    for ck in ("a", "b"):     # the second run replays every batch
        src = jobs.file_stream(spark, f"{land}/*", frame(spark, 0, 1).schema, max_files=1)
        jobs.run_available(src.writeStream.foreachBatch(jobs.bucketed_append_sink(path, KEY, ["ord"], 8))
                           .option("checkpointLocation", f"{scratch}/ck-{ck}"))
    got = keyed.table(spark, path)
    assert got.count() == 350 == got.select(*KEY).distinct().count()
