"""Search-result cache as a table.

Lookup is a left join on ``sha2(query_text)`` against unexpired rows; misses
are computed by the caller's search, each text once, and written back with a
TTL. The stored cache is a versioned table keyed by the hash
(``quire.operators.versions``). ``now`` is always a parameter so reruns are
reproducible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import versions

CACHE_SCHEMA = "query_hash string, query_text string, results string, created_at timestamp, expires_at timestamp"


def query_hash(text_col: str = "text"):
    return F.sha2(F.col(text_col), 256)


def cache_lookup(queries: DataFrame, cache: DataFrame, now: str,
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)``: hits carry the cached ``results`` of the newest
    valid row of their hash (by ``created_at``, then expiry)."""
    q = queries.withColumn("query_hash", query_hash(text_col))
    age = [F.col(c) for c in ("created_at", "expires_at") if c in cache.columns]
    valid = (cache.filter(F.col("expires_at") > F.to_timestamp(F.lit(now)))
             .groupBy("query_hash").agg(F.max_by("results", F.struct(*age, F.col("results"))).alias("results")))
    hits = q.join(valid, "query_hash")
    misses = q.join(valid, "query_hash", "left_anti")
    return hits, misses


def cached_search(queries: DataFrame, cache: DataFrame, now: str,
                  search: Callable[[DataFrame], DataFrame], ttl_minutes: int = 60,
                  id_col: str = "id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """V9: ``(answers, new_cache_rows)``. ``search`` maps missed queries to
    ``(id, results)`` (``results`` a JSON array string); it gets every missed
    text once, however many queries ask it, under the smallest of their ids.
    ``answers`` are ``(id, query_hash, results, from_cache)``."""
    hits, misses = cache_lookup(queries, cache, now, text_col)
    once = misses.groupBy("query_hash").agg(F.min(F.struct(id_col, text_col)).alias("_q")).select("query_hash", "_q.*")
    found = search(once.select(id_col, text_col)).join(once, id_col)
    # one row per missed text, a fraction of the queries
    fresh = found.select("query_hash", F.col(text_col).alias("query_text"), "results")
    answers = (hits.select(id_col, "query_hash", "results", F.lit(True).alias("from_cache"))
               .unionByName(misses.join(fresh, "query_hash").select(id_col, "query_hash", "results", F.lit(False).alias("from_cache"))))
    ts = F.to_timestamp(F.lit(now))
    new_rows = fresh.select("query_hash", "query_text", "results", ts.alias("created_at"),
                            (ts + F.expr(f"interval {int(ttl_minutes)} minutes")).alias("expires_at"))
    return answers, new_rows


def newest_per_hash(stored: DataFrame, new_rows: DataFrame) -> DataFrame:
    """One row for each ``query_hash``: the newest, by creation, expiry and
    then results."""
    both = stored.unionByName(new_rows)
    rest = [c for c in both.columns if c != "query_hash"]
    best = F.max_by(F.struct(*rest), F.struct("created_at", "expires_at", "results"))
    return both.groupBy("query_hash").agg(best.alias("_b")).select("query_hash", *[F.col(f"_b.{c}").alias(c) for c in rest])


def write_back(new_rows: DataFrame, base: str, buckets: int | None = None) -> versions.Version | None:
    """V9: the computed rows go into the cache table at ``base`` in one atomic
    step; ``query_hash`` stays unique whichever jobs write at a time."""
    return versions.merge(new_rows, base, ["query_hash"], newest_per_hash, buckets)


def search_through(queries: DataFrame, base: str, now: str, search: Callable[[DataFrame], DataFrame],
                   ttl_minutes: int = 60, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """V9 against the cache table at ``base`` (made when missing): looks up,
    searches what is missing, writes it back, and answers from the version
    that holds it. Each missed text is searched once."""
    spark = queries.sparkSession
    if versions.version(spark, base) is None:
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    else:
        stored = versions.read(spark, base)
    hits, misses = cache_lookup(queries, stored, now, text_col)
    _, new_rows = cached_search(misses.select(id_col, text_col), spark.createDataFrame([], CACHE_SCHEMA), now, search,
                                ttl_minutes, id_col, text_col)
    got = write_back(new_rows, base)
    held = versions.read(spark, base, got) if got else spark.createDataFrame([], CACHE_SCHEMA)
    return (hits.select(id_col, "query_hash", "results", F.lit(True).alias("from_cache"))
            .unionByName(misses.join(held.select("query_hash", "results"), "query_hash")
                         .select(id_col, "query_hash", "results", F.lit(False).alias("from_cache"))))


def expire(cache: DataFrame, now: str) -> DataFrame:
    """The rows to keep (``expires_at > now``)."""
    return cache.filter(F.col("expires_at") > F.to_timestamp(F.lit(now)))


def expire_table(spark: SparkSession, base: str, now: str) -> versions.Version:
    """V10 on the cache table at ``base``, in one atomic step; rows that other
    jobs write meanwhile are not lost."""
    return versions.rewrite(spark, base, lambda rows: expire(rows, now))
