"""Stored chunks with their vectors, kept in line with the documents (C2-C5,
E4, K2).

The table is versioned (``quire.operators.versions``), laid out by document.
``refresh`` chunks the documents, finds the documents whose chunks differ from
the stored ones, and rewrites their buckets in one atomic step. Vectors go by
the hash of the chunk's content: a content that is stored anywhere keeps its
vector, and a new content is embedded once, however many chunks have it. A
content crosses the shuffle once by its hash and once to its place in the table;
the chunks' other columns meet it without it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import chunking, embedding, versions
from quire.operators.sinks import stable_id

SCHEMA = "id string, doc_id string, chunk_index int, content string, content_hash string, embedding array<double>"


def default_embedder(contents: DataFrame) -> DataFrame:
    """``(content_hash, content)`` to ``(content_hash, embedding)``: raw signed
    counts (the cosine metric does its own normalisation)."""
    return embedding.hash_embed(contents, "content_hash", "content", normalize=False).select("content_hash", "embedding")


def chunk_table(documents: DataFrame, size: int = chunking.DEFAULT_CHUNK_SIZE) -> DataFrame:
    """``(id, doc_id, chunk_index, content, content_hash)`` of all chunks of
    ``documents (id, text)``."""
    c = chunking.chunk_documents(documents, size)
    return c.select(stable_id(F.col("doc_id"), F.col("chunk_index")).alias("id"), "doc_id",
                    F.col("chunk_index").cast("int").alias("chunk_index"), "content", F.sha2("content", 256).alias("content_hash"))


def _fingerprint(chunks: DataFrame) -> DataFrame:
    """One value for each document that changes with any chunk: sums of
    hashes, so that a document's chunks are never gathered."""
    h = F.xxhash64("chunk_index", "content_hash").cast("decimal(38,0)")
    return chunks.groupBy("doc_id").agg(F.sum(h).alias("sum"), F.count(F.lit(1)).alias("n"))


def refresh(documents: DataFrame, base: str, size: int = chunking.DEFAULT_CHUNK_SIZE,
            embedder: Callable[[DataFrame], DataFrame] = default_embedder, buckets: int | None = None) -> versions.Version | None:
    """Make the chunk table at ``base`` that of ``documents (id, text)``; a
    document that is no longer there loses its chunks. Refreshing again
    changes nothing and embeds nothing."""
    spark = documents.sparkSession
    held = versions.version(spark, base)
    chunks = chunk_table(documents, size)
    now = _fingerprint(chunks)
    if held is None:
        # nothing is stored: all chunks are new, and none is looked for
        changed, gone, known = chunks, None, None
        buckets = buckets or versions.default_buckets(now.agg(F.sum("n")).first()[0] or 0)
    else:
        stored = versions.read(spark, base)
        was = _fingerprint(stored)
        same = now.join(was, ["doc_id", "sum", "n"], "left_semi").select("doc_id")
        changed = chunks.join(same, "doc_id", "left_anti")
        # a document without chunks any more: a row that says so
        gone = (was.join(now, "doc_id", "left_anti").select("doc_id"))
        known = stored.groupBy("content_hash").agg(F.any_value("embedding").alias("embedding"))
    contents = changed.groupBy("content_hash").agg(F.any_value("content").alias("content"))
    fresh = embedder(contents if known is None else contents.join(known, "content_hash", "left_anti")).select("content_hash", "embedding")
    vectors = fresh if known is None else contents.join(known, "content_hash").select("content_hash", "embedding").unionByName(fresh)
    rows = (changed.select("id", "doc_id", "chunk_index", "content_hash").join(contents.join(vectors, "content_hash"), "content_hash")
            .select("id", "doc_id", "chunk_index", "content", "content_hash", "embedding"))
    if gone is not None:
        rows = rows.unionByName(gone, allowMissingColumns=True)

    def combine(held: DataFrame, new: DataFrame) -> DataFrame:
        there = new.filter(F.col("id").isNotNull())
        if held.isEmpty():
            return there
        return held.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(there)
    done = versions.merge(rows, base, ["doc_id"], combine, buckets)
    # what was shuffled goes when the driver collects its garbage
    spark.sparkContext._jvm.System.gc()
    return done
