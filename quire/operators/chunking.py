"""Chunking as table jobs.

The greedy packers (C2, C3) are sequential per document, so they are written
as an ``aggregate`` fold over the split array: one native expression per row,
no shuffle, no Python. Each document's text is processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.partitioning import spread
from quire.functions.text import py_strip, word_count

DEFAULT_CHUNK_SIZE = 1000


def _pack(parts: Column, size: int, joiner: str, suffix: str) -> Column:
    """Greedy packing fold: append ``x`` to the current chunk unless
    ``len(cur) + len(x) > size`` (joiner not counted) and ``cur`` is non-empty;
    every emitted chunk gets ``suffix``."""
    init = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        cur = acc["cur"]
        flush = (F.length(cur) + F.length(x) > size) & (cur != "")
        return F.struct(
            F.when(flush, x).when(cur != "", F.concat(cur, F.lit(joiner), x)).otherwise(x).alias("cur"),
            F.when(flush, F.array_append(acc["out"], F.concat(cur, F.lit(suffix)))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc):
        return F.when(acc["cur"] != "", F.array_append(acc["out"], F.concat(acc["cur"], F.lit(suffix)))) \
            .otherwise(acc["out"])

    return F.aggregate(parts, init, step, finish)


def _clean_parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern, -1), lambda p: py_strip(p)), lambda p: p != "")


def paragraph_chunks(text: Column, size: int = DEFAULT_CHUNK_SIZE) -> Column:
    """Split on blank line, trim, drop empties, pack joined by blank line."""
    return _pack(_clean_parts(F.coalesce(text, F.lit("")), "\n\n"), size, "\n\n", "")


def sentence_chunks(text: Column, size: int = DEFAULT_CHUNK_SIZE) -> Column:
    """C3 sentence path: newlines to spaces, split on ``". "``, pack joined by
    one space, ``"."`` appended to every chunk."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " ")
    return _pack(_clean_parts(flat, r"\. "), size, " ", ".")


def window_chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """C4: fixed windows of ``size`` characters starting every
    ``size - overlap``; stops at the first window that reaches the end."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    n = F.length(F.coalesce(text, F.lit("")))
    count = F.when(n == 0, F.lit(0)).when(n <= size, F.lit(1)) \
        .otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    return F.when(count == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(text, k * step + 1, size)))


def explode_chunks(df: DataFrame, chunks: Column, key_cols: list[str],
                   method: str = "immediate") -> DataFrame:
    """One row per chunk with ``chunk_index`` (0-based), ``content``,
    ``chunk_length``, ``token_count`` (whitespace words) and JSON metadata."""
    # posexplode_outer + filter: a plain explode makes the optimizer infer a
    # ``size(chunks) > 0`` filter and push it below the projection, which
    # would inline (re-run) the whole chunking fold for that test
    out = (df.select(*key_cols, F.posexplode_outer(chunks).alias("chunk_index", "content"))
           .filter(F.col("content").isNotNull()))
    return (out
            .withColumn("chunk_length", F.length("content"))
            .withColumn("token_count", word_count(F.col("content")))
            .withColumn("metadata", F.to_json(F.struct(
                F.col("chunk_index"), F.lit(method).alias("processing_method"),
                F.lit("text").alias("chunk_type")))))


def with_simple_chunks(df: DataFrame, text_col: str, out_col: str = "chunks",
                       size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """C2 then C3 as a column: the sentence path replaces the paragraph result
    when that gave nothing or any chunk is longer than ``2 * size``. The
    paragraph result is computed once (a separate projection the optimizer keeps, since it is used three
    times) and the sentence fold only evaluated for the rows that need it.
    One fold serves texts of every length: it holds the current chunk and
    references to the finished ones."""
    t = F.col(text_col)
    para = df.withColumn("_para", paragraph_chunks(t, size))
    redo = (F.size("_para") == 0) | F.exists("_para", lambda c: F.length(c) > 2 * size)
    return para.withColumn(out_col, F.when(redo, sentence_chunks(t, size)).otherwise(F.col("_para"))).drop("_para")


def chunk_documents(documents: DataFrame, size: int = DEFAULT_CHUNK_SIZE,
                    id_col: str = "id", text_col: str = "text") -> DataFrame:
    """C2/C3 + C5 over a documents table: ``(doc_id, chunk_index, content, ...)``."""
    d = spread(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")), "doc_id")
    d = with_simple_chunks(d, "_t", "_chunks", size)
    return explode_chunks(d, F.col("_chunks"), ["doc_id"])


def chunks_of(chunks: DataFrame, requested: DataFrame, key: str = "doc_id") -> DataFrame:
    """C6 (rows): chunks of the requested documents, or the documents to chunk
    (semi-join; order by ``chunk_index`` when reading)."""
    return chunks.join(requested.select(key).distinct(), key, "left_semi")


def collect_chunks(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """C6 (nested): per document the chunk contents ordered by ``chunk_index``.

    The array grows with one document's chunks only (bounded by its text)."""
    return (chunks.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("_c"))
            .select(key, F.transform("_c", lambda s: s["content"]).alias("contents")))
