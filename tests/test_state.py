import datetime as dt

from pyspark.sql import functions as F

from quire.operators import cache, dialogue, sinks

T0 = dt.datetime(2024, 1, 1)


def test_soft_and_hard_delete(spark):
    convs = spark.createDataFrame([("c1", "t"), ("c2", "u")], "id string, title string")
    msgs = spark.createDataFrame([("m1", "c1"), ("m2", "c2"), ("m3", "c2")], "id string, conv_id string")
    req = spark.createDataFrame([("c2",)], "id string")
    c, m = dialogue.delete_conversations(convs, msgs, req)
    assert [r.id for r in c.collect()] == ["c1"] and [r.id for r in m.collect()] == ["m1"]
    c, m = dialogue.delete_conversations(convs, msgs, req, soft=True)
    assert {r.id: r.status for r in c.collect()} == {"c1": "active", "c2": "deleted"} and m.count() == 3


def test_archive_written_as_new_version(spark, scratch):
    convs = spark.createDataFrame([("c1", T0), ("c2", T0 + dt.timedelta(days=5))], "id string, updated_at timestamp")
    out = sinks.write_version(dialogue.archive_split(convs, "2024-01-03 00:00:00"), f"{scratch}/conv", 1,
                              partition_by=["status"])
    got = {r.id: r.status for r in spark.read.parquet(out).collect()}
    assert got == {"c1": "archived", "c2": "active"}


def test_add_documents_keeps_order_without_duplicates(spark):
    convs = spark.createDataFrame([("c1", ["a", "b"]), ("c2", None)], "id string, doc_ids array<string>")
    adds = spark.createDataFrame([("c1", 2, "c"), ("c1", 1, "b"), ("c1", 3, "a"), ("c2", 1, "z")],
                                 "conv_id string, seq int, doc_id string")
    got = {r.id: r.doc_ids for r in dialogue.add_documents(convs, adds).collect()}
    assert got == {"c1": ["a", "b", "c"], "c2": ["z"]}


def test_cache_hits_misses_and_expiry(spark):
    now = "2024-01-01 10:00:00"
    queries = spark.createDataFrame([("q1", "hello"), ("q2", "world"), ("q3", "stale")], "id string, text string")
    store = spark.createDataFrame(
        [("hello", '["x"]', T0 + dt.timedelta(hours=9, minutes=30), T0 + dt.timedelta(hours=10, minutes=30)),
         ("stale", '["y"]', T0, T0 + dt.timedelta(hours=1))],
        "t string, results string, created_at timestamp, expires_at timestamp") \
        .withColumn("query_hash", F.sha2("t", 256)).drop("t")

    def search(miss):
        return miss.select("id", F.lit('["fresh"]').alias("results"))

    answers, new_rows = cache.cached_search(queries, store, now, search, ttl_minutes=60)
    got = {r.id: (r.from_cache, r.results) for r in answers.collect()}
    assert got == {"q1": (True, '["x"]'), "q2": (False, '["fresh"]'), "q3": (False, '["fresh"]')}
    rows = new_rows.collect()
    assert len(rows) == 2 and all(r.expires_at - r.created_at == dt.timedelta(hours=1) for r in rows)
    assert cache.expire(store, now).count() == 1


def test_cache_answers_from_the_newest_row(spark):
    t = dt.datetime(2024, 1, 1)
    h = spark.sql("select sha2('q', 256) h").first().h
    rows = [(h, "old", t, t + dt.timedelta(days=9)), (h, "new", t + dt.timedelta(hours=1), t + dt.timedelta(days=3)),
            (h, "gone", t + dt.timedelta(hours=2), t)]
    store = spark.createDataFrame(rows, "query_hash string, results string, created_at timestamp, expires_at timestamp")
    hits, misses = cache.cache_lookup(spark.createDataFrame([("a", "q")], "id string, text string"), store, "2024-01-02 00:00:00")
    assert [r.results for r in hits.collect()] == ["new"] and misses.count() == 0


def test_users_keep_the_given_id(spark):
    users = spark.createDataFrame([("1", "ann")], "id string, username string")
    inc = spark.createDataFrame([("1", None), (None, "ann"), ("7", "bob"), ("8", "bob"), (None, "eve"), ("9", None), (None, None)],
                                "id string, username string")
    got = {(r.req_id, r.req_username): (r.user_id, r.created) for r in sinks.resolve_users(inc, users).collect()}
    eve = spark.sql("select substring(sha2('eve', 256), 1, 16) h").first().h
    assert got == {("1", None): ("1", False), (None, "ann"): ("1", False), ("7", "bob"): ("7", True), ("8", "bob"): ("7", True),
                   (None, "eve"): (eve, True), ("9", None): ("9", False), (None, None): (None, False)}
    new = sorted((r.id, r.username) for r in sinks.new_users(sinks.resolve_users(inc, users)).collect())
    assert new == sorted([("7", "bob"), (eve, "eve")])


def test_failing_read_fails_the_sinks(spark, scratch):
    """A stored table that can't be read must never count as a missing one."""
    import pytest

    from quire.streaming import jobs
    rows = spark.createDataFrame([("d1", "processed", None, dt.datetime(2024, 1, 1), 1)],
                                 "doc_id string, status string, error string, ts timestamp, seq long")
    sink = jobs.status_merge_sink(f"{scratch}/st")
    sink(rows, 0)
    kb = [x for x in __import__("glob").glob(f"{scratch}/st/data/*/_kb=*/*.parquet")]
    with open(kb[0], "wb") as f:          # the only data file is damaged
        f.write(b"not parquet")
    with pytest.raises(Exception):
        sink(rows, 1)
    with open(f"{scratch}/keyed", "w") as f:
        f.write("a file where the table's folder should be")
    with pytest.raises(Exception):
        sinks.append_idempotent(rows, f"{scratch}/keyed", ["doc_id"], ["seq"])
    assert not sinks.table_exists(spark, f"{scratch}/nothing")


def test_rows_without_key_are_set_aside(spark, scratch):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "b"), (None, 2, "y")], "k string, ord int, v string")
    sinks.append_idempotent(rows, f"{scratch}/t", ["k"], ["ord"])
    assert [(r.k, r.v) for r in spark.read.parquet(f"{scratch}/t").collect()] == [("a", "b")]
    assert [r.v for r in sinks.without_key(rows, ["k"]).collect()] == ["y"]


def test_admission_and_text_of_odd_files(spark):
    from quire.sources import files
    df = spark.createDataFrame([(None, 5), ("/a.txt", None), ("/a.txt", 5), ("/a.exe", 5)], "path string, length long")
    got = [(r.admitted, r.reject_reason) for r in files.admit(df).collect()]
    assert got[0] == (False, "path missing") and got[1] == (False, "size unknown") and got[2] == (True, None) and not got[3][0]
    raw = [b"ok \xef\xbf\xbd end", b"bad \xff \xef\xbf\xbd \xc3\x28 end", b"\xe2\xef\xbf\xbd", "é😀".encode()]
    d = spark.createDataFrame([(bytearray(b),) for b in raw], "c binary")
    out = [r.t for r in d.select(files.extract_text(F.col("c"), F.lit("x.txt")).alias("t")).collect()]
    assert out == [b.decode("utf-8", errors="ignore") for b in raw]


def test_files_are_hashed_whatever_their_size(spark, scratch):
    import hashlib
    import os

    from quire.sources import files
    os.makedirs(f"{scratch}/more of it")
    sizes = {"b.bin": 100, "more of it/c 1.bin": 101, "d.bin": 5000}
    for name, n in sizes.items():
        with open(f"{scratch}/{name}", "wb") as f:
            f.write(os.urandom(n))
    # longer than any row can be (a hole, which takes no disk)
    with open(f"{scratch}/e.bin", "wb") as f:
        f.write(b"start")
        f.truncate((2 << 30) + 5)
    h = hashlib.sha256(b"start")
    for _ in range(2 << 10):
        h.update(bytes(1 << 20))
    want = {name: (n, hashlib.sha256(open(f"{scratch}/{name}", "rb").read()).hexdigest()[:16]) for name, n in sizes.items()}
    want["e.bin"] = ((2 << 30) + 5, h.hexdigest()[:16])
    for whole in (files.WHOLE_BYTES, 100):
        got = files.hashed_files(files.scan_files(spark, scratch, glob="*.bin"), whole).collect()
        assert {r.path.split(scratch + "/")[1]: (r["length"], r.content_hash) for r in got} == want
        assert len(got) == len(want)
