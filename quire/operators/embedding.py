"""Embeddings.

The default embedder needs no model: each whitespace token is hashed with
MD5; the first 8 hex digits pick a bucket (mod ``width``) and the next two a
sign; bucket values are signed token counts, L2-normalised on request. It is
computed natively: tokens are exploded and summed per ``(id, bucket)`` with a
map-side partial aggregate, so at most ``width`` rows per text cross the
shuffle whatever the text length.

Model embedders plug in through ``embed_batches`` (``mapInPandas``: Arrow
batches in, fixed-size model batches inside, keys carried through).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.partitioning import spread
from quire.functions.text import NON_WS

DEFAULT_WIDTH = 64


def _bucket(h: Column, width: int) -> Column:
    """Bucket from a token's MD5 hex digest."""
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(width))


def _sign(h: Column) -> Column:
    """Sign from a token's MD5 hex digest."""
    return F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") < 128, F.lit(1)).otherwise(F.lit(-1))


def hash_embed_sparse(df: DataFrame, id_col: str, text_col: str,
                      width: int = DEFAULT_WIDTH, normalize: bool = True) -> DataFrame:
    """E1 (sparse form): ``(id, bucket, value)`` for non-zero buckets."""
    tok = spread(df.select(id_col, text_col), id_col).select(
        F.col(id_col).alias("_id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(NON_WS + "+"), 0)).alias("_t"))
    hashed = tok.select("_id", F.md5("_t").alias("_h"))
    s = (hashed.groupBy("_id", _bucket(F.col("_h"), width).alias("bucket"))
         .agg(F.sum(_sign(F.col("_h"))).alias("_v"))
         .filter(F.col("_v") != 0))
    if normalize:
        from pyspark.sql import Window
        n = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy("_id")))
        s = s.withColumn("value", F.col("_v") / n)
    else:
        s = s.withColumn("value", F.col("_v").cast("double"))
    return s.select(F.col("_id").alias(id_col), F.col("bucket").cast("int").alias("bucket"), "value")


def densify(sparse: DataFrame, id_col: str, width: int = DEFAULT_WIDTH,
            out_col: str = "embedding") -> DataFrame:
    """Sparse ``(id, bucket, value)`` to ``array<double>`` of ``width``
    (the per-id list is bounded by ``width``)."""
    g = sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("_m"))
    return g.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                                        lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0))).alias(out_col))


def hash_embed(df: DataFrame, id_col: str, text_col: str, width: int = DEFAULT_WIDTH,
               normalize: bool = True, out_col: str = "embedding") -> DataFrame:
    """E1 (dense form): ``df`` with ``out_col``; texts without tokens get a
    zero vector."""
    dense = densify(hash_embed_sparse(df, id_col, text_col, width, normalize), id_col, width, out_col)
    zero = F.array_repeat(F.lit(0.0), width)
    return (df.join(dense, id_col, "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), zero)))


# ---------------------------------------------------------------- pluggable

def python_hash_embedder(width: int = DEFAULT_WIDTH, normalize: bool = True) -> Callable[[Sequence[str]], list]:
    """The default embedder as a plain Python callable (same values as E1);
    an example of what ``embed_batches`` accepts."""
    def embed(texts: Sequence[str]) -> list:
        out = []
        for t in texts:
            v = np.zeros(width)
            for tok in (t or "").split():
                h = hashlib.md5(tok.encode("utf-8")).hexdigest()
                v[int(h[:8], 16) % width] += 1 if int(h[8:10], 16) < 128 else -1
            if normalize:
                n = np.sqrt((v * v).sum())
                if n > 0:
                    v = v / n
            out.append(v.tolist())
        return out
    return embed


def embed_batches(df: DataFrame, key_cols: list[str], text_col: str,
                  embedder: Callable[[Sequence[str]], list], batch_size: int = 10,
                  out_col: str = "embedding") -> DataFrame:
    """Call ``embedder`` on batches of ``batch_size`` texts, in order,
    inside ``mapInPandas``; keys are carried through unchanged."""
    fields = [df.schema[c] for c in key_cols]
    schema = T.StructType(fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(it):
        for pdf in it:
            texts = pdf[text_col].tolist()
            vecs = []
            for s in range(0, len(texts), batch_size):
                vecs.extend(embedder(texts[s:s + batch_size]))
            out = pdf[key_cols].copy()
            out[out_col] = vecs
            yield out

    return spread(df.select(*key_cols, text_col), key_cols[0]).mapInPandas(run, schema)


def embed_queries(df: DataFrame, id_col: str, text_col: str, width: int = DEFAULT_WIDTH,
                  normalize: bool = True) -> DataFrame:
    """Query embeddings with failures as rows: ``success`` false and a
    ``message`` for empty queries instead of an exception."""
    from quire.functions.text import is_blank
    e = hash_embed(df, id_col, text_col, width, normalize)
    blank = is_blank(F.col(text_col))
    return (e.withColumn("success", ~blank)
            .withColumn("message", F.when(blank, F.lit("Empty query text")).otherwise(F.lit("ok")))
            .withColumn("embedding", F.when(blank, F.lit(None)).otherwise(F.col("embedding"))))


def embed_distinct(df: DataFrame, id_col: str, text_col: str, width: int = DEFAULT_WIDTH,
                   normalize: bool = True) -> DataFrame:
    """Embed each distinct text once (keyed by SHA-256) and join back.

    Returns the sparse form per original id: ``(id, text_hash, bucket, value)``.
    """
    h = df.select(id_col, F.sha2(F.col(text_col), 256).alias("text_hash"), text_col)
    uniq = h.select("text_hash", text_col).dropDuplicates(["text_hash"])
    emb = hash_embed_sparse(uniq, "text_hash", text_col, width, normalize)
    return h.select(id_col, "text_hash").join(emb, "text_hash")
