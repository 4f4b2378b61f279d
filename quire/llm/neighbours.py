"""Approximate nearest neighbours by a permutation index.

``pivots`` fixed vectors, taken from a bounded sample, order every vector: its
permutation lists the pivots by descending inner product, cut to the nearest
``length``. Two vectors whose permutations agree lie close; disagreement is
Spearman's footrule, where a pivot outside a list counts as rank ``length``.

Vectors are dealt by a hash of their id into shards of bounded size. A shard
is a pivot inverted file: for each pivot the vectors that list it, with its
rank there; the lists of a shard lie side by side, a small number for each
vector. A query only visits the posting lists of its own pivots and each
visited entry moves that vector's footrule down from the value of two disjoint
lists, a whole list at a time. The shard's vectors up to the footrule of the ``share`` nearest (equal
footrules are all taken) are reranked by the exact inner product in double
precision, and the best ``k`` of every shard are merged. Queries travel in
blocks; one row of the join is one (shard, query block) of bounded size, so
neither a hot vector nor a large query set makes a large task.

Defined results: a vector that is null, zero, of a width other than the
table's most frequent one, or holds null or non-finite components takes no part,
nor does a row with a null id; rows with repeated ids are candidates one by
one, but one answer is given for each distinct query id; ties go to the smaller id;
tables of at most ``k`` usable vectors give all other rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 256
LENGTH = 64
#: The pivots come from the rows lowest by a hash of their id.
SAMPLE = 4096
SHARE = 0.15
SHARD_ROWS = 8192
QUERY_ROWS = 1024


def usable(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column) -> DataFrame:
    """``(id, v, asks)`` of the vectors that take part; queries and candidates
    share one width."""
    v = F.col("v")
    ok = (F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
          & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
          & F.exists(v, lambda x: x != 0))
    d = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                       F.coalesce(is_query, F.lit(False)).alias("asks")).filter(ok)
    width = d.groupBy(F.size("v").alias("w")).count().orderBy(F.col("count").desc(), "w").limit(1).collect()
    return d.filter(F.size("v") == (width[0]["w"] if width else 0))


def choose_pivots(d: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Distinct vectors of a bounded sample, in the order of a hash."""
    rows = (d.withColumn("h", F.xxhash64("id", F.lit("pivot"))).orderBy("h", "id").limit(sample).select("v").collect())
    seen = dict.fromkeys(tuple(r["v"]) for r in rows)
    out = np.array(list(seen)[:pivots], float)
    return out / np.linalg.norm(out, axis=1, keepdims=True) if len(out) else out


def permutations(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first (ties to the lower)."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length].astype(np.int16)


class InvertedFile:
    """Posting lists of a shard, side by side: for each pivot a row that holds
    ``m - s`` for every vector that lists it at rank ``s``, else 0."""

    def __init__(self, perms: np.ndarray, n_pivots: int):
        n, m = perms.shape
        self.n, self.m = n, m
        self.kind = np.uint8 if m <= 255 else np.int32
        caps = np.arange(m, 0, -1).astype(self.kind)
        self.near = np.zeros((n_pivots, n), self.kind)
        self.near[perms.ravel(), np.repeat(np.arange(n), m)] = np.tile(caps, n)
        # as wide as the lists: numpy takes a single number several times slower
        self.caps = np.repeat(caps[:, None], n, axis=1)
        # ranks in runs whose caps add up within the kind
        self.runs, lo, total = [], 0, 0
        for r, cap in enumerate(caps.tolist()):
            if total + cap > np.iinfo(self.kind).max:
                self.runs.append(slice(lo, r))
                lo, total = r, 0
            total += cap
        self.runs.append(slice(lo, m))

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule of every vector from ``perm``, cut at rank ``m``. A shared
        pivot replaces ``(m - r) + (m - s)`` by ``|r - s|``, which is less by
        twice the lesser of ``m - r`` and ``m - s``."""
        shared = np.zeros(self.n, np.int32)
        one, run = np.empty(self.n, self.kind), np.empty(self.n, self.kind)
        for at in self.runs:
            run[:] = 0
            for p, cap in zip(perm[at].tolist(), self.caps[at]):
                run += np.minimum(self.near[p], cap, out=one)
            shared += run
        return self.m * (self.m + 1) - 2 * shared


def _blob(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _gather(d: DataFrame, n: int, name: str, piv: np.ndarray, m: int) -> DataFrame:
    """Rows ``(<name>, ids, vecs, perms)`` with all vectors of a shard or block
    and their permutations, which are worked out here, once."""
    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # copies of an id in one order on every retry
        pdf = pdf.assign(b=[_blob(x, "<f8") for x in pdf["v"]]).sort_values(["id", "b"], kind="stable")
        x = np.stack(pdf["v"].to_list())
        return pd.DataFrame({name: [key[0]], "ids": [_blob(pdf["id"].to_numpy(), "<i8")], "vecs": [_blob(x, "<f8")],
                             "perms": [_blob(permutations(x, piv, m), "<i2")]})
    # repeated ids are kept, so a hash of id and vector would put all copies
    # of a row into one shard; the id alone already spreads copies of vectors
    dealt = d.withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.lit(n)).cast("int"))
    return dealt.groupBy(name).applyInPandas(one, f"{name} int, ids binary, vecs binary, perms binary")


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
           pivots: int = PIVOTS, length: int = LENGTH, share: float = SHARE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that satisfies
    ``is_query`` its ``k`` nearest other rows found."""
    d = usable(vectors, id_col, vec_col, is_query)
    # of queries with one id the one with the least vector, on every retry
    q = d.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    n = d.count()
    n_shards, n_blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-q.count() // QUERY_ROWS))
    piv = choose_pivots(d, pivots)
    n_pivots, m = len(piv), min(length, len(piv))

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, qids = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.qids, "<i8")
                x = np.frombuffer(r.vecs, "<f8").reshape(len(ids), -1)
                qx = np.frombuffer(r.qvecs, "<f8").reshape(len(qids), -1)
                inv = InvertedFile(np.frombuffer(r.perms, "<i2").reshape(len(ids), m), n_pivots)
                most = float(np.sqrt((x * x).sum(axis=1)).max())
                take = min(len(ids), max(4 * k, int(np.ceil(share * len(ids)))))
                got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                for qid, v, perm in zip(qids, qx, np.frombuffer(r.qperms, "<i2").reshape(len(qids), m)):
                    f = inv.footrule(perm)
                    cand = np.flatnonzero(f <= np.partition(f, take - 1)[take - 1])
                    cand = cand[ids[cand] != qid]
                    s = x.take(cand, axis=0) @ v
                    # all that can be among the best k, whatever their ties:
                    # the two ways to multiply differ by rounding only
                    if len(cand) > k:
                        slack = 4e-16 * len(v) * most * float(np.linalg.norm(v))
                        keep = s >= np.partition(s, len(s) - k)[len(s) - k] - slack
                        cand = cand[keep]
                    s = np.array([float(np.dot(x[c], v)) for c in cand])
                    best = np.lexsort((ids[cand], -s))[:k]
                    got.append((np.full(len(best), qid), ids[cand[best]], s[best]))
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*got)))))

    shards = _gather(d, n_shards, "shard", piv, m).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    blocks = (_gather(q, n_blocks, "block", piv, m).withColumnsRenamed({"ids": "qids", "vecs": "qvecs", "perms": "qperms"})
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))))
    units = shards.repartition(n_shards * n_blocks, "shard", "block").join(
        blocks.repartition(n_shards * n_blocks, "shard", "block"), ["shard", "block"])
    near = units.select("ids", "vecs", "perms", "qids", "qvecs", "qperms").mapInPandas(unit, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
