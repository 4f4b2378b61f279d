"""Search queries: V1-V5, V11 over the fixture (every embedding is a query)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.search import knn, search_results, search_summary, threshold
from quire.plans.catalog import register
from quire.views import Fixture, duck_cte

K = 5

_DIST_SQL = {
    "l2": "list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[])",
    "cosine": ("1 - list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / "
               "(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * "
               "sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])))"),
    "ip": "-list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])",
}


def _score_sql(metric: str) -> str:
    return "-distance" if metric == "ip" else "1 - distance"


def _spark_search(spark, sf_dir, metric, scoped=False):
    fx = Fixture(spark, sf_dir)
    chunks = fx.chunks()
    hits = knn(fx.queries(), chunks, k=K, metric=metric, exclude_self=True,
               scope=fx.scope() if scoped else None)
    res = search_results(hits, chunks, fx.documents(), metric)
    return res.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "doc_id",
        F.col("chunk_index").cast("bigint").alias("chunk_index"), "filename",
        F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def _oracle_search(metric, scoped=False):
    scope_join = "join v_scope s on s.qid = q.qid and s.doc_id = c.doc_id" if scoped else ""
    views = ["v_chunks", "v_queries", "v_documents"] + (["v_scope"] if scoped else [])
    return duck_cte(*views) + f"""
, pairs as (
  select q.qid, c.id as chunk_id, c.doc_id, c.chunk_index, {_DIST_SQL[metric]} as distance
  from v_queries q join v_chunks c on cast(q.qid as varchar) <> c.id
  {scope_join}
), ranked as (
  select *, row_number() over (partition by qid order by distance, chunk_id) as rank
  from pairs where distance is not null and isfinite(distance)
)
select r.qid, cast(r.rank as bigint) as rank, r.chunk_id, r.doc_id,
       cast(r.chunk_index as bigint) as chunk_index, d.filename,
       round(r.distance, 6) as distance, round({_score_sql(metric).replace('distance', 'r.distance')}, 6) as score
from ranked r left join v_documents d on d.id = r.doc_id
where r.rank <= {K}
"""


@register("v1_knn_l2", _oracle_search("l2"))
def v1_knn_l2(spark, sf_dir):
    """V1: exact 5 nearest chunks by L2 for every query, with document."""
    return _spark_search(spark, sf_dir, "l2")


@register("v2_knn_cosine", _oracle_search("cosine"))
def v2_knn_cosine(spark, sf_dir):
    """V2: exact 5 nearest by cosine distance."""
    return _spark_search(spark, sf_dir, "cosine")


@register("v3_knn_ip", _oracle_search("ip"))
def v3_knn_ip(spark, sf_dir):
    """V3: exact 5 best by inner product."""
    return _spark_search(spark, sf_dir, "ip")


@register("v4_knn_scoped", _oracle_search("l2", scoped=True))
def v4_knn_scoped(spark, sf_dir):
    """V4: scope filter applied before ranking (query sees only its documents)."""
    return _spark_search(spark, sf_dir, "l2", scoped=True)


_V5_SQL = duck_cte("v_chunks", "v_queries") + f"""
, pairs as (
  select q.qid, c.id as chunk_id, {_DIST_SQL['cosine']} as distance
  from v_queries q join v_chunks c on cast(q.qid as varchar) <> c.id
), ranked as (
  select *, row_number() over (partition by qid order by distance, chunk_id) as rank
  from pairs where distance is not null and isfinite(distance)
)
select qid, cast(rank as bigint) as rank, chunk_id, round(1 - distance, 6) as similarity
from ranked where rank <= {K} and 1 - distance >= 0.2
"""


@register("v5_threshold", _V5_SQL)
def v5_threshold(spark, sf_dir):
    """V5: cosine top-5, then keep similarity >= threshold (after the limit).

    The fixture's random unit vectors sit far apart, so the threshold used
    here is 0.2 (the reference default 0.7 keeps nothing on them).
    """
    fx = Fixture(spark, sf_dir)
    hits = knn(fx.queries(), fx.chunks(), k=K, metric="cosine", exclude_self=True)
    kept = threshold(hits.withColumn("similarity", F.lit(1.0) - F.col("distance")), 0.2)
    return kept.select("qid", F.col("rank").cast("bigint").alias("rank"),
                       F.col("id").alias("chunk_id"), F.round("similarity", 6).alias("similarity"))


_V11_SQL = duck_cte("v_chunks", "v_queries", "v_scope") + f"""
, pairs as (
  select q.qid, c.id as chunk_id, {_DIST_SQL['cosine']} as distance
  from v_queries q join v_chunks c on cast(q.qid as varchar) <> c.id
  join v_scope s on s.qid = q.qid and s.doc_id = c.doc_id
), ranked as (
  select *, row_number() over (partition by qid order by distance, chunk_id) as rank
  from pairs where distance is not null
), kept as (select * from ranked where rank <= {K} and 1 - distance >= 0.25)
select q.qid, cast(count(k.chunk_id) as bigint) as results_count,
       count(k.chunk_id) > 0 as success,
       case when count(k.chunk_id) > 0 then 'Found ' || cast(count(k.chunk_id) as varchar) || ' results'
            else 'No results found' end as message
from v_queries q left join kept k on k.qid = q.qid
group by q.qid
"""


@register("v11_search_summary", _V11_SQL)
def v11_search_summary(spark, sf_dir):
    """Per query result count and success flag of a scoped, thresholded search."""
    fx = Fixture(spark, sf_dir)
    hits = knn(fx.queries(), fx.chunks(), k=K, metric="cosine", exclude_self=True,
               scope=fx.scope())
    kept = hits.filter(F.lit(1.0) - F.col("distance") >= 0.25)
    return search_summary(fx.queries(), kept)
