"""Atomic table commits: a job that dies after any step, and jobs that meet."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from quire.operators import cache, dialogue, versions
from quire.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
STEPS = ["_write_rows", "_write_manifest", "_publish"]
LOG = "doc_id string, status string, error string, ts timestamp, seq long"


class Killed(Exception):
    pass


def log(spark, lo, hi, seq):
    return spark.createDataFrame([(f"d{i}", f"s{seq}", None, T0 + dt.timedelta(hours=seq), seq) for i in range(lo, hi)], LOG)


def statuses(spark, base):
    return {r.doc_id: r.new_status for r in versions.read(spark, base).collect()}


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_dead_batch_and_its_replay_leave_the_right_table(spark, scratch, monkeypatch, step, when):
    base = f"{scratch}/t"
    sink = jobs.status_merge_sink(base, key_buckets=4)
    sink(log(spark, 0, 40, 1), 0)
    before, reader = statuses(spark, base), versions.read(spark, base)
    after = {**before, **{f"d{i}": "s2" for i in range(30, 60)}}
    real = getattr(versions, step)

    def dies(*a):
        if when == "after":
            real(*a)
        raise Killed
    monkeypatch.setattr(versions, step, dies)
    with pytest.raises(Killed):
        sink(log(spark, 30, 60, 2), 1)
    monkeypatch.setattr(versions, step, real)
    # whole old table, or whole new one once the last step is done
    assert statuses(spark, base) == (after if (step, when) == ("_publish", "after") else before)
    sink(log(spark, 30, 60, 2), 1)
    assert statuses(spark, base) == after
    sink(log(spark, 30, 60, 2), 1)      # replayed once more
    assert statuses(spark, base) == after
    assert {r.doc_id: r.new_status for r in reader.collect()} == before   # a reader of the old version sees it whole


def test_rows_half_written_are_never_read(spark, scratch, monkeypatch):
    base = f"{scratch}/t"
    versions.overwrite(log(spark, 0, 10, 1), base, ["doc_id"], 3)
    real = versions._write_rows

    def half(rows, base, commit, key, n):
        real(rows.limit(3), base, commit, key, n)
        raise Killed
    monkeypatch.setattr(versions, "_write_rows", half)
    for call in (lambda: versions.append(log(spark, 5, 20, 2), base, ["doc_id"]),
                 lambda: versions.rewrite(spark, base, lambda t: t.filter("false")),
                 lambda: versions.overwrite(log(spark, 0, 1, 3), base, ["doc_id"], 2)):
        with pytest.raises(Killed):
            call()
    assert versions.read(spark, base).count() == 10 and versions.version(spark, base).number == 1


def test_vacuum_keeps_what_versions_name(spark, scratch, monkeypatch):
    base = f"{scratch}/t"
    sink = jobs.status_merge_sink(base, key_buckets=4, keep=2)
    for i in range(7):
        sink(log(spark, 5 * i, 5 * i + 30, i + 1), i)
    want = statuses(spark, base)
    assert versions.vacuum(spark, base, keep=2) >= 0
    assert statuses(spark, base) == want and len(want) == 60
    v = versions.version(spark, base)
    assert versions.read(spark, base, v.number - 1).count() == 55
    with pytest.raises(Exception):
        versions.read(spark, base, 1)
    named = {(c, b) for n in (v.number, v.number - 1) for b, cs in versions.version(spark, base, n).parts.items() for c in cs}
    held = {(d[7:], int(k[4:])) for d in os.listdir(f"{base}/data") for k in os.listdir(f"{base}/data/{d}") if k.startswith("_kb=")}
    assert held == named
    # a vacuum that dies in between leaves every kept version readable
    monkeypatch.setattr(versions, "_file_system", lambda *a: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        versions.vacuum(spark, base, keep=1)
    monkeypatch.undo()
    assert statuses(spark, base) == want


def test_two_jobs_at_a_time(spark, scratch, monkeypatch):
    base = f"{scratch}/t"
    versions.overwrite(log(spark, 0, 40, 1), base, ["doc_id"], 8)
    real, calls = versions._write_manifest, []

    def other_first(s, b, v):
        if not calls:
            calls.append(1)
            jobs.status_merge_sink  # the other job's change lands while this one has written its rows
            versions.append(log(spark, 100, 105, 9), base, ["doc_id"])
        return real(s, b, v)
    monkeypatch.setattr(versions, "_write_manifest", other_first)
    versions.append(log(spark, 40, 50, 2), base, ["doc_id"])
    assert versions.read(spark, base).count() == 55 and versions.version(spark, base).number == 3
    calls.clear()
    versions.rewrite(spark, base, lambda t: t.filter("seq > 1"))       # sees the five rows that came first
    assert versions.read(spark, base).count() == 20
    monkeypatch.undo()
    v = versions.version(spark, base)
    with pytest.raises(versions.Conflict):
        versions._commit(spark, base, v)


def test_merges_of_other_buckets_meet_without_new_work(spark, scratch, monkeypatch):
    base = f"{scratch}/t"
    newest = lambda a, b: a.unionByName(b).groupBy("doc_id").agg(F.max_by(F.struct("status", "error", "ts", "seq"), "seq").alias("x")).select("doc_id", "x.*")
    rows = log(spark, 0, 200, 1)
    versions.overwrite(rows, base, ["doc_id"], 16)
    bucket = versions.key_bucket(["doc_id"], 16)
    mine, theirs, same = (log(spark, 0, 200, 2).filter(bucket == 3), log(spark, 0, 200, 3).filter(bucket == 5),
                          log(spark, 0, 200, 3).filter(bucket == 3))
    for other in (theirs, same):
        real, writes, first = versions._write_manifest, [], []
        real_rows = versions._write_rows

        def other_first(s, b, v):
            if not first:
                first.append(1)
                versions.merge(other, base, ["doc_id"], newest)
            return real(s, b, v)
        monkeypatch.setattr(versions, "_write_manifest", other_first)
        monkeypatch.setattr(versions, "_write_rows", lambda *a: writes.append(a[2]) or real_rows(*a))
        versions.merge(mine, base, ["doc_id"], newest)
        monkeypatch.undo()
        # two writes: each job its own; a third where both touched bucket 3
        assert len(writes) == (2 if other is theirs else 3)
    got = {r.doc_id: r.status for r in versions.read(spark, base).collect()}
    assert len(got) == 200
    kb = {r.doc_id: r.k for r in rows.select("doc_id", bucket.alias("k")).collect()}
    assert all(got[d] == {3: "s3", 5: "s3"}.get(k, "s1") for d, k in kb.items())


def test_a_named_writer_appends_each_batch_once(spark, scratch):
    base = f"{scratch}/t"
    for batch in (0, 1, 1, 0, 2):
        versions.append(log(spark, 10 * batch, 10 * batch + 10, 1), base, ["doc_id"], 4, writer="w", batch=batch)
    versions.append(log(spark, 0, 10, 1), base, ["doc_id"], writer="other", batch=0)
    assert versions.read(spark, base).count() == 40


def test_cache_table_searches_each_text_once(spark, scratch):
    base, now = f"{scratch}/cache", "2024-01-01 10:00:00"
    asked = spark.sparkContext.accumulator(0)
    texts = ["crowd"] * 3000 + [f"t{i}" for i in range(5)]
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "id string, text string")

    def search(miss):
        def one(it):
            for pdf in it:
                asked.add(len(pdf))
                yield pdf.assign(results='["r"]')[["id", "results"]]
        return miss.mapInPandas(one, "id string, results string")
    got = cache.search_through(queries, base, now, search)
    assert got.count() == 3005 and not got.filter("from_cache").count()
    assert asked.value == 6
    again = cache.search_through(queries, base, now, search)
    assert again.filter("from_cache").count() == 3005 and asked.value == 6
    # two jobs that both missed leave one row for each hash
    _, rows = cache.cached_search(queries, spark.createDataFrame([], cache.CACHE_SCHEMA), now, search)
    cache.write_back(rows, base)
    cache.write_back(rows, base)
    assert versions.read(spark, base).count() == 6
    cache.expire_table(spark, base, "2024-01-01 10:59:59")
    assert versions.read(spark, base).count() == 6
    cache.expire_table(spark, base, "2024-01-01 11:00:00")
    assert versions.read(spark, base).count() == 0
    assert cache.search_through(queries, base, "2024-01-01 12:00:00", search).filter("from_cache").count() == 0


def test_status_and_archive_tables(spark, scratch):
    docs = spark.createDataFrame([(f"d{i}", f"f{i}", "uploaded", "{}") for i in range(20)],
                                 "id string, filename string, status string, metadata string")
    base = f"{scratch}/docs"
    versions.overwrite(docs, base, ["id"], 4)
    for _ in range(2):
        dialogue.apply_status_table(log(spark, 3, 6, 1), base)
    got = {r.id: r.status for r in versions.read(spark, base).collect()}
    assert len(got) == 20 and {d for d, s in got.items() if s == "s1"} == {"d3", "d4", "d5"}
    convs = spark.createDataFrame([("c1", T0, None), ("c2", T0 + dt.timedelta(days=5), None)],
                                  "id string, updated_at timestamp, status string")
    versions.overwrite(convs, f"{scratch}/convs", ["id"])
    dialogue.archive_table(spark, f"{scratch}/convs", "2024-01-03 00:00:00")
    assert {r.id: r.status for r in versions.read(spark, f"{scratch}/convs").collect()} == {"c1": "archived", "c2": "active"}


def test_a_large_bucket_is_written_by_several_tasks(spark, scratch):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    rows = spark.range(0, 20_000, 1, 8).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("x"))
    try:
        spark.conf.set(size, "100k")
        v = versions.overwrite(rows, f"{scratch}/t", ["id"], 1)
    finally:
        spark.conf.set(size, before)
    got = versions.read(spark, f"{scratch}/t")
    assert list(v.parts) == [0] and len(got.inputFiles()) > 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
