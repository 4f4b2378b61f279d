"""Plan-shape checks: the physical plans we rely on for scale."""
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_broadcast_knn_scans_items_once(spark):
    from quire.operators.search import knn
    from quire.views import Fixture
    fx = Fixture(spark, SF)
    p = formatted(knn(fx.queries(), fx.chunks(), k=5))
    assert "MapInPandas" in p and "WindowGroupLimit" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scoped_knn_is_blocked_cogroup(spark):
    from quire.operators.search import knn
    from quire.views import Fixture
    fx = Fixture(spark, SF)
    p = formatted(knn(fx.queries(), fx.chunks(), k=5, scope=fx.scope(), force_blocked=True))
    assert "FlatMapCoGroupsInPandas" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_small_scoped_knn_stays_broadcast(spark):
    from quire.operators.search import knn
    from quire.views import Fixture
    fx = Fixture(spark, SF)
    p = formatted(knn(fx.queries(), fx.chunks(), k=5, scope=fx.scope()))
    assert "MapInPandas" in p and "FlatMapCoGroupsInPandas" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_last_messages_limits_before_shuffle(spark):
    from quire.operators.dialogue import last_messages
    from quire.views import Fixture
    p = formatted(last_messages(Fixture(spark, SF).messages(), 5))
    assert "WindowGroupLimit" in p


def test_inventory_reads_no_bytes(spark):
    from quire.sources import files
    inv = files.file_inventory(files.scan_files(spark, SF, glob="*.parquet"))
    p = formatted(inv)
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in p


def test_filter_and_projection_reach_scan(spark):
    from quire.operators.dialogue import last_user_message
    from quire.views import Fixture
    p = formatted(last_user_message(Fixture(spark, SF).messages()))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in p


@pytest.fixture(scope="module")
def registered():
    import __spark_entry__ as e
    from quire.plans.catalog import QUERIES
    return {k: v for k, v in e.queries().items() if k in QUERIES}


def test_no_cross_products_in_registered_queries(spark, registered):
    skip = ("st", "v6", "v7", "v8")  # streaming / model-fitting queries run on call
    for name, fn in registered.items():
        if name.startswith(skip):
            continue
        p = plan(fn(spark, SF))
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["qid", "rank", "chunk_id", "doc_id", "chunk_index", "filename", "distance", "score"]


def test_stored_ivf_index_is_pruned(spark, scratch):
    from quire.operators import ann
    from quire.views import Fixture
    fx = Fixture(spark, SF)
    ch = fx.chunks().select("id", "embedding")
    cents, assigned = ann.ivf_train(ch, lists=20)
    ann.write_ivf_index(assigned, f"{scratch}/ivf")
    stored = spark.read.parquet(f"{scratch}/ivf")
    q = fx.queries().limit(3)          # a small query batch probes few lists
    plans = []
    real = ann.knn

    def spy(*a, **kw):
        out = real(*a, **kw)
        if kw.get("scope") is not None:
            plans.append(formatted(out))
        return out
    ann.knn = spy
    try:
        hits = ann.ivf_search(q, ann.list_bounds(cents, stored), stored, k=5, nprobe=2, max_probe=4)
    finally:
        ann.knn = real
    assert len(plans) == 2 and all(re.search(r"PartitionFilters: \[.*list_id#\d+ IN ", p) for p in plans)
    assert hits.count() == 15


def test_spread_only_when_few_files(spark, scratch):
    from quire.functions.partitioning import spread
    one = spark.read.parquet(f"{SF}/documents.parquet")
    assert "REPARTITION_BY_NUM" in formatted(spread(one, "doc_id"))
    many = spark.range(0, 1000, numPartitions=16).withColumn("k", F.col("id") % 7)
    many.write.parquet(f"{scratch}/many")
    again = spark.read.parquet(f"{scratch}/many")
    assert "REPARTITION_BY_NUM" not in formatted(spread(again, "k"))


def test_chunk_fold_evaluated_once_per_path(spark):
    from quire.operators.chunking import chunk_documents
    from quire.views import Fixture
    p = plan(chunk_documents(Fixture(spark, SF).documents()))
    # one paragraph fold and one sentence fold; no inferred filter re-running them
    assert p.count("aggregate(") == 2
