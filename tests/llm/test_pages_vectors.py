"""WARC round trips and the permutation index against brute force."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import neighbours, warc
from quire.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_records(rows):
    out, best = [], {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        to = best.get(b) if len(b) >= 1000 and i is not None and best[b] != i else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return out


ODD = [(1, "http://a.example.com/x", "short"), (2, None, None), (3, "", ""), (4, "http://EXAMPLE.com:80?q", "p" * 1000),
       (5, "http://example.com/", "p" * 1000), (6, "not a url\r\nX: y", "p" * 1000), (7, "http://b/é", "a\r\n\r\nWARC/1.0\r\n\r\nb"),
       (8, "http://b/é", "é" * 500), (9, "http://u@b/", "é" * 500), (10, "x", "é" * 499), (11, "x", "é" * 499),
       (None, "http://n/", "p" * 1000), (1 << 60, "x", "z" * 200_000), (12, "x: y", "\n\r\n\r\n")]


@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_round_trip(spark, archive_bytes):
    docs = spark.createDataFrame([(*r, 1, "p") for r in ODD], "page_id long, url string, html string, offset int, path string")
    got = warc.round_trip(docs, archive_bytes=archive_bytes).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted([(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == \
        sorted(plain_records(ODD), key=key)
    html = {i: h or "" for i, _, h in ODD}
    assert all(r.payload == html[r.id] for r in got if r.record_type == "response")


def test_repeated_rows(spark):
    rows = [(1, "http://a/", "q" * 1500)] * 3 + [(2, "http://a/", "q" * 1500), (2, "http://a/", "other")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.id, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.round_trip(docs).collect())
    assert got == [(1, "revisit", 2, 1500)] * 3 + [(2, "response", 0, 5), (2, "response", 0, 1500)]


def test_empty_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_op7_on_the_fixture(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                 for r in QUERIES["op7_warc"](spark, SF).collect())
    assert got == sorted(plain_records(rows))


def test_index_looks_up_single_pages(spark, scratch):
    rows = [(i, f"http://h{i % 7}.example.org/{i}", f"page {i} " * 50) for i in range(3000)]
    index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch + "/w")
    assert index.count() > 1
    asked = spark.createDataFrame([(rows[17][1], 17), (rows[2999][1], 2999), ("http://none/", 5)], "url string, id long")
    got = warc.read_records(warc.look_up(asked, index)).collect()
    assert sorted((r.id, r.payload) for r in got) == [(17, rows[17][2]), (2999, rows[2999][2])]
    # the archives give the same entries when they are read from end to end
    found = warc.entries(warc.archive_files(spark, scratch + "/w/archives"))
    bare = F.regexp_replace("path", "^file:/*", "/")
    assert sorted(map(tuple, found.withColumn("path", bare).collect())) == sorted(map(tuple, spark.read.parquet(scratch + "/w/entries").collect()))


def test_a_look_up_opens_one_block_and_one_range(spark, scratch):
    """Everything but the bytes that a request needs is spoilt, and it is
    answered still."""
    import glob
    rows = [(i, f"http://h{i % 7}.example.org/{i}", f"page {i} " * 50) for i in range(3000)]
    index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch + "/w", archive_bytes=20_000)
    asked = spark.createDataFrame([(rows[1234][1], 1234)], "url string, id long")
    blocks = index.orderBy("first_key", "first_id").collect()
    want = (warc.reversed_host_key(rows[1234][1]), 1234)
    block = [b for b in blocks if (b.first_key, b.first_id) <= want][-1]
    entry = spark.read.parquet(scratch + "/w/entries").filter("id = 1234").first()
    needed = {block.path: (block.offset, block.length), entry.path: (entry.offset, entry.length)}
    files = glob.glob(scratch + "/w/archives/*.gz") + glob.glob(scratch + "/w/index/blocks/*.idx")
    assert len(files) > 20 and block.length < sum(b.length for b in blocks) / 3
    for path in files:
        with open(path, "rb") as f:
            data = f.read()
        at, n = needed.get(path, (0, 0))
        with open(path, "wb") as f:
            f.write(b"\xff" * at + data[at:at + n] + b"\xff" * (len(data) - at - n))
    got = warc.read_records(warc.look_up(asked, index)).collect()
    assert [(r.id, r.payload) for r in got] == [(1234, rows[1234][2])]
    other = spark.createDataFrame([(rows[5][1], 5)], "url string, id long")
    with pytest.raises(Exception):
        warc.read_records(warc.look_up(other, index)).collect()


def test_file_systems():
    assert warc.file_system("/a/b")[1] == "/a/b" and warc.file_system("file:/a/b")[1] == "/a/b" and warc.file_system("file:///a/b")[1] == "/a/b"


def test_keys():
    assert warc.reversed_host_key("http://www.Example.com/a?b") == "com,example,www)/a?b"
    assert warc.reversed_host_key("https://h:81") == "h:81)/" and warc.reversed_host_key(None) == ""


def plain_search(ids, x, queries, k=20):
    out = {}
    for q in queries:
        i = list(ids).index(q)
        s = np.array([float(np.dot(x[j], x[i])) for j in range(len(ids))])
        at = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in at]
    return out


def test_op10_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toPandas()
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_list()).astype(float)
    want = plain_search(ids, x, [i for i in ids if i % 20 == 0])
    got = {}
    for r in QUERIES["op10_permutation_index"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    by = {i: v for i, v in zip(ids, x)}
    hits = 0
    for q, v in got.items():
        assert v == sorted(v, key=lambda s: (-s[1], s[0]))
        assert all(s == float(np.dot(by[i], by[q])) for i, s in v)
        hits += len({i for i, _ in v} & {i for i, _ in want[q]})
    assert hits / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("m, n_pivots", [(64, 256), (300, 400), (3, 3)])
def test_footrule_of_whole_lists(m, n_pivots):
    """The footrule as defined, in well under the time that it takes to go
    through the lists entry by entry."""
    rng = np.random.default_rng(5)
    perms = np.stack([rng.permutation(n_pivots)[:m] for _ in range(4096)]).astype(np.int16)
    inv = neighbours.InvertedFile(perms, n_pivots)
    rank = np.full((len(perms), n_pivots), m)
    np.put_along_axis(rank, perms.astype(int), np.arange(m)[None, :], axis=1)
    for q in range(3):
        assert inv.footrule(perms[q]).tolist() == np.abs(rank - rank[q]).sum(axis=1).tolist()
    if m != 64:
        return
    flat = perms.ravel()
    order = np.argsort(flat, kind="stable")
    item, at, cut = order // m, order % m, np.searchsorted(flat[order], np.arange(n_pivots + 1))

    def entry_by_entry(perm):
        d = np.full(len(perms), m * (m + 1), np.int32)
        for r, p in enumerate(perm):
            lo, hi = cut[p], cut[p + 1]
            d[item[lo:hi]] -= 2 * (m - np.maximum(r, at[lo:hi]))
        return d

    def took(f):
        times = []
        for q in range(30):
            began = time.thread_time()
            f(perms[q])
            times.append(time.thread_time() - began)
        return sorted(times)[15]
    assert took(inv.footrule) < 0.7 * took(entry_by_entry)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (6, [None, 1.0]), (40, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0]), (60, None)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, shard int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(docs, F.col("vec_id") % 20 == 0, k=2).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 7, 1.0), (20, 1, 1, 2.0), (20, 2, 7, 2.0)]
    assert neighbours.search(docs.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_many_equal_vectors_tie_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 2 else [float(i), 1.0, -50.0]) for i in range(1, 400)] + [(400, [1.0, 2.0, 3.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in neighbours.search(docs, F.col("vec_id") == 400, k=20).orderBy("rank").collect()]
    assert got == list(range(1, 40, 2))


def test_queries_have_the_width_of_the_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=2).tolist()) for i in range(1, 60)]
    rows += [(100 + 20 * i, [1.0, 2.0, 3.0]) for i in range(9)]     # most queries have another width
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(docs, F.col("vec_id") % 20 == 0, k=3, share=1.0).collect()
    want = plain_search(np.array([i for i, _ in rows[:59]]), np.array([v for _, v in rows[:59]]), [20, 40], 3)
    assert {r.query_id for r in got} == {20, 40}
    assert sorted((r.query_id, r.vec_id) for r in got) == sorted((q, i) for q, v in want.items() for i, _ in v)
    assert neighbours.search(docs, F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e8])
def test_ties_at_any_scale(spark, scale):
    """Products that are equal but for the order of their terms."""
    v = [0.1 * scale, 0.7 * scale, -0.3 * scale]
    rows = [(i, [v[(i + j) % 3] for j in range(3)]) for i in range(1, 300)] + [(300, [scale] * 3)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in neighbours.search(docs, F.col("vec_id") == 300, k=20, share=1.0).orderBy("rank").collect()]
    x = {i: np.array(e) for i, e in rows}
    want = sorted(((i, float(np.dot(x[i], x[300]))) for i in range(1, 300)), key=lambda t: (-t[1], t[0]))[:20]
    assert got == want
