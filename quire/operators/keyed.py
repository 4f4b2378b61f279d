"""Keyed append tables whose stored side is never shuffled (K1, K5, ST2).

The table is Parquet, bucketed by its key with Spark's own bucketing, so the
scan already has the partitioning that a join on the key asks for. A batch is
dealt to the same buckets and met there:

- a small batch (``SMALL_ROWS``) is sent to the stored keys instead: they are
  cut to those the batch has while they are scanned, and neither sorted nor
  moved;
- a larger one is sorted and merged with the stored keys, bucket by bucket;
  only the batch crosses an exchange.

The number of buckets is chosen when the table is made, from the rows that it
is expected to hold, and kept beside the files, so that every session reads
the same layout. ``rebucket`` copies a table that has outgrown it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.sinks import _file_system, first_per_key

#: Batches up to this many keys are broadcast (a key of a few texts is some
#: hundred bytes at most in the executors' hash table).
SMALL_ROWS = 100_000
#: Rows that a bucket is meant for.
BUCKET_ROWS = 5_000_000
MAX_BUCKETS = 20_000
_META = "_keyed.json"


def buckets_for(rows: int) -> int:
    return max(1, min(MAX_BUCKETS, -(-rows // BUCKET_ROWS)))


def _meta(spark: SparkSession, path: str) -> dict | None:
    fs, p = _file_system(spark, f"{path}/{_META}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def create(spark: SparkSession, path: str, key: Sequence[str], schema, buckets: int) -> None:
    """Make an empty table; a table that stands there already must have the
    same key."""
    held = _meta(spark, path)
    if held is None:
        fs, p = _file_system(spark, f"{path}/{_META}")
        stream = fs.create(p, False)
        try:
            stream.write(bytearray(json.dumps({"key": list(key), "buckets": buckets, "schema": json.loads(schema.json())}).encode()))
        finally:
            stream.close()
    elif held["key"] != list(key):
        raise ValueError(f"{path} is keyed by {held['key']}, not by {list(key)}")


def _name(spark: SparkSession, path: str) -> str:
    """The table in the session's catalog, entered when it isn't there."""
    held = _meta(spark, path)
    name = "quire_keyed_" + hashlib.sha1(path.encode()).hexdigest()[:16]
    if not spark.catalog.tableExists(name):
        cols = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in T.StructType.fromJson(held["schema"]).fields)
        by = ", ".join(f"`{k}`" for k in held["key"])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet CLUSTERED BY ({by}) "
                  f"INTO {held['buckets']} BUCKETS LOCATION '{path}'")
    return name


def table(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, partitioned by bucket."""
    spark.catalog.refreshTable(_name(spark, path))
    return spark.table(_name(spark, path))


def rows_to_append(incoming: DataFrame, path: str, key: Sequence[str], order: Sequence[str], small: bool) -> DataFrame:
    """K1: the batch's rows with new keys, first per key, dealt to the table's
    buckets."""
    spark = incoming.sparkSession
    n = _meta(spark, path)["buckets"]
    # the aggregation and the join both use this partitioning
    first = first_per_key(incoming.repartition(n, *[F.col(k) for k in key]), key, order)
    stored = table(spark, path).select(*key)
    if small:
        stored = stored.join(F.broadcast(incoming.select(*key).distinct()), list(key), "left_semi")
        # at most as many as the batch has
        return first.join(F.broadcast(stored.distinct()), list(key), "left_anti")
    return first.hint("merge").join(stored, list(key), "left_anti")


def append(incoming: DataFrame, path: str, key: Sequence[str], order: Sequence[str], buckets: int | None = None,
           small_rows: int = SMALL_ROWS) -> int:
    """Add the rows whose key the table at ``path`` doesn't hold (made when
    missing, with ``buckets`` or as many as sixteen batches like this one
    need). Returns how many rows the batch had. A replay adds nothing."""
    spark = incoming.sparkSession
    batch = incoming.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = batch.count()
        create(spark, path, key, incoming.schema, buckets or buckets_for(16 * rows))
        cols = [c["name"] for c in _meta(spark, path)["schema"]["fields"]]
        new = rows_to_append(batch, path, key, order, rows <= small_rows)
        new.select(*cols).write.insertInto(_name(spark, path))
    finally:
        batch.unpersist()
    return rows


def rebucket(spark: SparkSession, path: str, target: str, buckets: int | None = None) -> None:
    """The table at ``path`` copied to ``target`` with another number of
    buckets (by default what its rows ask for)."""
    held = _meta(spark, path)
    rows = table(spark, path)
    create(spark, target, held["key"], rows.schema, buckets or buckets_for(2 * rows.count()))
    n = _meta(spark, target)["buckets"]
    rows.repartition(n, *[F.col(k) for k in held["key"]]).write.insertInto(_name(spark, target))
