"""Keyed sinks on Parquet (K1-K5).

Parquet has no MERGE, so "insert, do nothing on conflict" is an anti-join of
the batch against the stored keys followed by an append. Duplicates inside a
batch are collapsed with ``min_by`` over the stated order: a partial
aggregate, so a key repeated a billion times is reduced map-side instead of
being gathered into one window partition. Ids are deterministic hashes of
natural keys, so a rerun produces the same rows and appends nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import word_count


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``, equal ones by their other
    columns. Rows with a null key part have no key: ``without_key`` returns
    them."""
    key = list(key)
    cols = [c for c in df.columns if c not in key]
    ok = df
    for k in key:
        ok = ok.filter(F.col(k).isNotNull())
    tie = [c for c in cols if c not in order and not isinstance(df.schema[c].dataType, T.MapType)]
    best = F.min_by(F.struct(*cols), F.struct(*[F.col(o) for o in order], *[F.col(c) for c in tie]))
    return ok.groupBy(*key).agg(best.alias("_b")).select(*key, *[F.col(f"_b.{c}").alias(c) for c in cols])


def without_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows that a keyed sink sets aside: those with a null key part."""
    bad = F.lit(False)
    for k in key:
        bad = bad | F.col(k).isNull()
    return df.filter(bad)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder with data files stands at ``path``, asked from its
    file system; an unreachable store raises."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return False
    # partition folders may start with an underscore, marker files do too
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return any("=" in n or not n.startswith(("_", ".")) for n in names)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this job wrote."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def rows_to_append(incoming: DataFrame, existing: DataFrame, key: Sequence[str],
                   order: Sequence[str]) -> DataFrame:
    """K1: the rows an ``INSERT .. ON CONFLICT (key) DO NOTHING`` would add."""
    first = first_per_key(incoming, key, order)
    return first.join(existing.select(*key), list(key), "left_anti")


def key_bucket(key: Sequence[str], n: int) -> Column:
    """Partition bucket of a key: ``pmod(xxhash64(key), n)``."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(n)).cast("int")


def append_idempotent(incoming: DataFrame, target_path: str, key: Sequence[str],
                      order: Sequence[str], partition_by: Sequence[str] = (),
                      key_buckets: int | None = None) -> DataFrame:
    """K1 write: append the new rows to the Parquet table at ``target_path``
    (created when missing). Returns the appended rows (lazy).

    With ``key_buckets`` the table is laid out by ``_kb`` (a hash bucket of
    the key). The batch is persisted for the duration of the write, its
    distinct buckets (at most ``key_buckets`` integers) are collected, and
    the stored keys are read only from those bucket folders (static
    partition pruning): a small micro-batch never scans the whole table.
    """
    spark = incoming.sparkSession
    key = list(key)
    buckets = None
    if key_buckets:
        incoming = incoming.withColumn("_kb", key_bucket(key, key_buckets)).persist(StorageLevel.MEMORY_AND_DISK)
        buckets = [r[0] for r in incoming.select("_kb").distinct().collect()]  # <= key_buckets values
        key = key + ["_kb"]
        partition_by = ["_kb", *partition_by]
    try:
        # a failing read must fail the batch: only a missing table is empty
        if table_exists(spark, target_path):
            existing = spark.read.parquet(target_path)
            if buckets is not None:
                existing = existing.filter(F.col("_kb").isin(buckets))
            existing = existing.select(*key)
        else:
            existing = spark.createDataFrame([], incoming.select(*key).schema)
        new = rows_to_append(incoming, existing, key, order)
        out = new.select(*incoming.columns)
        if partition_by:
            # one writer per partition folder: no task opens every folder
            out = out.repartition(*partition_by)
        w = out.write.mode("append")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(target_path)
    finally:
        if key_buckets:
            incoming.unpersist()
    return new


def stable_id(*parts: Column) -> Column:
    """Deterministic row id: SHA-256 of the natural key parts joined by ``:``."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def chunk_rows(chunks: DataFrame, created_at: str, n_buckets: int = 64) -> DataFrame:
    """K2: stored chunk projection: deterministic id, content default ``''``,
    page ids and metadata as JSON, creation stamp, optional embedding, and a
    ``bucket`` of ``doc_id`` to partition the files by."""
    emb = F.col("embedding") if "embedding" in chunks.columns else F.lit(None).cast("array<float>")
    pages = F.to_json(F.col("page_ids")) if "page_ids" in chunks.columns else F.lit(None).cast("string")
    content = F.coalesce(F.col("content"), F.lit(""))
    return chunks.select(
        stable_id(F.col("doc_id"), F.col("chunk_index")).alias("id"),
        F.col("doc_id"), F.col("chunk_index"), content.alias("content"),
        pages.alias("page_ids"), emb.alias("embedding"),
        F.to_json(F.struct(F.col("chunk_index"), F.lit("text").alias("type"))).alias("metadata"),
        word_count(content).alias("token_count"),
        F.to_timestamp(F.lit(created_at)).alias("created_at"),
        F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).alias("bucket"))


def resolve_users(incoming: DataFrame, users: DataFrame) -> DataFrame:
    """K4: get-or-create users in bulk. Match by ``id``, else by
    ``username``; else the user is created and keeps the given id, or gets a
    hash of the username when none came in. Several new requests with one
    username are one user: the one with the smallest given id. A request with
    neither a known id nor a username can't be resolved (``user_id`` is the
    given id, ``created`` false). Incoming duplicates collapse to one
    resolution per ``(req_id, req_username)``."""
    inc = incoming.select(F.col("id").alias("req_id"), F.col("username").alias("req_username")).distinct()
    by_id = users.select(F.col("id").alias("_uid_id"), F.col("id").alias("_k_id"))
    by_name = (users.filter(F.col("username").isNotNull()).groupBy(F.col("username").alias("_k_name"))
               .agg(F.min("id").alias("_uid_name")))
    j = (inc.join(by_id, inc["req_id"] == by_id["_k_id"], "left")
         .join(by_name, inc["req_username"] == by_name["_k_name"], "left")
         .withColumn("_found", F.coalesce("_uid_id", "_uid_name")))
    new = (j.filter(F.col("_found").isNull() & F.col("req_username").isNotNull())
           .groupBy(F.col("req_username").alias("_n_name")).agg(F.min("req_id").alias("_n_id")))
    new = new.withColumn("_n_id", F.coalesce("_n_id", F.substring(F.sha2("_n_name", 256), 1, 16)))
    j = j.join(new, j["req_username"] == new["_n_name"], "left")
    return j.select("req_id", "req_username",
                    F.coalesce("_found", "_n_id", "req_id").alias("user_id"),
                    (F.col("_found").isNull() & F.col("_n_id").isNotNull()).alias("created"))


def new_users(resolved: DataFrame) -> DataFrame:
    """K4: the rows to insert, ``(id, username)``, one for each created user."""
    return (resolved.filter("created").groupBy(F.col("user_id").alias("id"))
            .agg(F.min("req_username").alias("username")))


def new_conversations(incoming: DataFrame, conversations: DataFrame) -> DataFrame:
    """K5: incoming conversation rows whose id does not exist yet (first per
    id by ``seq``), to append."""
    first = first_per_key(incoming, ["id"], ["seq"])
    return first.join(conversations.select("id"), "id", "left_anti")


def write_chunks(rows: DataFrame, path: str) -> DataFrame:
    """K2 write: insert-or-ignore the stored-chunk rows on their
    deterministic ``id``, partitioned by ``bucket`` of ``doc_id`` (a
    document's chunks sit in one folder; lookups by document prune to one
    bucket). A rerun appends nothing. Returns the appended rows."""
    return append_idempotent(rows, path, ["id"], ["chunk_index"], partition_by=["bucket"])


def write_version(df: DataFrame, base: str, version: int, partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` as ``base/v<version>`` (never over the folder being read;
    V10 expiry, U5 archive). Returns the new folder."""
    out = f"{base}/v{version}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(out)
    return out
