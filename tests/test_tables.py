import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.partitioning import ordered_index, quantile_index, text_number
from quire.operators import dialogue, lookup, prompts, quality, sinks

TS = dt.datetime(2024, 1, 1)


def _msgs(spark, rows):
    return spark.createDataFrame(
        [(f"{c}-{t}", c, t, r, x, TS + dt.timedelta(minutes=t)) for c, t, r, x in rows],
        "id string, conv_id string, turn long, role string, text string, created_at timestamp")


def test_idempotent_append(spark, scratch):
    schema = "path string, user_id string, page_id string, text string, ord int"
    batch1 = spark.createDataFrame([("p", "u", "1", "first", 0), ("p", "u", "1", "second", 1),
                                    ("p", "u", None, "nullkey", 0), ("p", "u", "2", "x", 0)], schema)
    key = ["path", "user_id", "page_id"]
    target = f"{scratch}/pages"
    sinks.append_idempotent(batch1, target, key, ["ord"])
    rows = {r.page_id: r.text for r in spark.read.parquet(target).collect()}
    assert rows == {"1": "first", "2": "x"}
    # rerun and a batch with a stored key: nothing new, one new key
    sinks.append_idempotent(batch1, target, key, ["ord"])
    batch2 = spark.createDataFrame([("p", "u", "2", "again", 0), ("p", "u", "3", "new", 0)], schema)
    sinks.append_idempotent(batch2, target, key, ["ord"])
    rows = sorted((r.page_id, r.text) for r in spark.read.parquet(target).collect())
    assert rows == [("1", "first"), ("2", "x"), ("3", "new")]


def test_status_log_ties_and_unknown(spark):
    log = spark.createDataFrame([("d1", "processing", None, TS, 1), ("d1", "failed", "boom", TS, 2),
                                 ("zz", "processed", None, TS, 3)],
                                "doc_id string, status string, error string, ts timestamp, seq long")
    docs = spark.createDataFrame([("d1", "f1", "uploaded"), ("d2", "f2", "uploaded")],
                                 "id string, filename string, status string")
    out = {r.id: (r.status, r.error) for r in dialogue.apply_status(docs, dialogue.latest_status(log)).collect()}
    assert out == {"d1": ("failed", "boom"), "d2": ("uploaded", None)}


def test_message_windows(spark):
    rows = [("a", 1, "assistant", "only reply")]                       # no user message
    rows += [("b", 1, "user", "q1"), ("b", 2, "user", "q2"), ("b", 3, "assistant", "r")]
    rows += [("c", 1, "user", "solo")]
    rows += [("d", t, "user" if t % 2 else "assistant", f"m{t}") for t in range(1, 12)]
    m = _msgs(spark, rows)
    last = {r.conv_id: (r.turn, r.text) for r in dialogue.last_user_message(m).collect()}
    assert "a" not in last and last["b"] == (2, "q2") and last["d"] == (11, "m11")
    ex = {r.user_message_id: r.answer for r in dialogue.exchanges(m).collect()}
    assert ex["b-1"] is None and ex["b-2"] == "r" and ex["c-1"] is None and ex["d-1"] == "m2" and ex["d-11"] is None
    w = dialogue.last_messages(m, 10).filter("conv_id = 'd'").orderBy("pos").collect()
    assert [r.turn for r in w] == list(range(2, 12)) and [r.pos for r in w] == list(range(1, 11))
    fx = {r.id: r.is_first_exchange for r in dialogue.first_exchange_flag(m).collect()}
    assert fx["b-2"] and not fx["b-3"]


def test_ordered_index_hot_key(spark):
    # payload columns, 120k rows, a hot and a null key, several shuffle widths
    df = spark.range(0, 120_000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 != 1, (F.col("id") % 50).cast("string")).alias("k"),
        (F.col("id") * 7919 % 120_000).alias("v"), F.concat(F.lit("text "), F.col("id")).alias("payload"), F.lit(1.5).alias("x"))
    exp = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("v")).cast("long"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = ordered_index(df, ["k"], ["v"], F.floor(F.col("v") / 1000))
            assert got.count() == 120_000
            assert got.exceptAll(exp).count() == 0
            few = ordered_index(df, ["k"], ["v"], F.floor(F.col("v") / 1000)).select("k", "v", "pos")
            assert few.exceptAll(exp.select("k", "v", "pos")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    down = ordered_index(df, ["k"], [F.col("v").desc()], F.floor(F.col("v") / 1000), slice_desc=True)
    exp = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc())).cast("long"))
    assert down.exceptAll(exp).count() == 0


def test_titles_and_answers(spark):
    convs = spark.createDataFrame(
        [("c0", None, None), ("c1", None, ["d1"]), ("c2", None, ["d1", "d2"]), ("c3", None, ["d1", "d2", "d3"]),
         ("c4", None, ["x", "y"]), ("c5", "Given", ["d1"])], "id string, title string, doc_ids array<string>")
    docs = spark.createDataFrame([("d1", "a.txt"), ("d2", "b.md"), ("d3", "c.pdf")], "id string, filename string")
    t = {r.id: r.new_title for r in prompts.title_from_documents(convs, docs).collect()}
    assert t == {"c0": "New Conversation", "c1": "Chat with a.txt", "c2": "Chat with a.txt, b.md",
                 "c3": "Chat with a.txt, b.md and 1 more", "c4": "Document Chat", "c5": "Given"}
    df = spark.createDataFrame([("x" * 22,), ("y" * 23,)], "t string")
    assert [r.d for r in df.select(prompts.display_title(F.col("t")).alias("d")).collect()] == ["x" * 22, "y" * 22 + "..."]
    answers = ["no tags here", "Summary: s1 Summary: again\nTitle: T1\nTitle: T2", "x Title: not at start",
               "Summary:  spaced  \nTitle:   "]
    a = spark.createDataFrame([(x,) for x in answers], "answer string")
    s, ti = prompts.parse_answer(F.col("answer"))
    got = [(r.s, r.t) for r in a.select(s.alias("s"), ti.alias("t")).collect()]
    assert got == [("", "New Conversation"), ("s1  again", "T2"), ("", "New Conversation"),
                   ("spaced", "New Conversation")]


def test_chat_prompt_layout(spark):
    m = _msgs(spark, [("c", 1, "user", "hello"), ("c", 2, "assistant", "hi there")])
    last5 = dialogue.last_messages(m, 5)
    ctx = spark.createDataFrame([("c", 1, "chunk one"), ("c", 2, "z" * 600)], "conv_id string, position int, content string")
    p = prompts.chat_prompt(spark.createDataFrame([("c",)], "conv_id string"), last5, ctx).first()
    assert p.prompt == ("You are a helpful document intelligence assistant. You can answer questions about "
                        "uploaded documents and provide general assistance.\n\nRelevant document context:"
                        "\nDocument 1: chunk one\nDocument 2: " + "z" * 500 +
                        "\n\nConversation:\nUser: hello\nAssistant: hi there\n\nAssistant:")
    assert p.context_docs_count == 2


def test_fallback_label(spark):
    df = spark.createDataFrame([("this is it", False), ("my document", False), ("help me", False),
                                ("zzz", False), ("anything", True)], "t string, c boolean")
    got = [r.l for r in df.select(prompts.fallback_label(F.col("t"), F.col("c")).alias("l")).collect()]
    assert got == ["greeting", "document", "help", "other", "context"]


def test_quality_checks(spark):
    msgs = spark.createDataFrame([("m1", "c1", "user"), ("m1", "c1", "assistant"), ("m2", "zz", "r" * 21),
                                  (None, "c1", "owner")], "id string, conv_id string, role string")
    convs = spark.createDataFrame([("c1",)], "id string")
    assert quality.duplicate_keys(msgs, ["id"]).count() == 1
    assert quality.null_keys(msgs, ["id"]).count() == 1
    assert [r.conv_id for r in quality.orphans(msgs, "conv_id", convs, "id").collect()] == ["zz"]
    dv = {r.role: r.reason for r in quality.domain_violations(msgs, "role", ["user", "assistant", "system"], 20).collect()}
    assert dv == {"r" * 21: "longer than 20", "owner": "value not allowed"}
    nc = {r.column: r.nulls for r in quality.null_counts(msgs, ["id", "role"]).collect()}
    assert nc == {"id": 1, "role": 0}
    raw = spark.createDataFrame([("1", "2.5", "x"), ("2", "bad", "y")], "event_id string, value string, extra string")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()),
                           T.StructField("missing", T.StringType())])
    good, aside = quality.conform(raw, schema)
    assert good.columns == ["event_id", "value", "missing"] and good.count() == 1
    assert [(r.row_key, r.column, r.value) for r in aside.collect()] == [("2", "value", "bad")]


def test_scope_rules(spark):
    convs = spark.createDataFrame([("c1", "u1", ["d9"]), ("c2", "u1", None)], "id string, user_id string, doc_ids array<string>")
    docs = spark.createDataFrame([("d1", "u1", "processed"), ("d2", "u1", "failed"), ("d3", "u2", "processed")],
                                 "id string, user_id string, status string")
    own = sorted(tuple(r) for r in lookup.search_scope(convs, docs).collect())
    assert own == [("c1", "d9"), ("c2", "d1")]
    assert sorted(tuple(r) for r in lookup.search_scope(convs, docs, "none").collect()) == [("c1", "d9")]
    assert ("c2", None) in [tuple(r) for r in lookup.search_scope(convs, docs, "all").collect()]
    scope, items = lookup.search_scope_keys(convs, docs)
    assert sorted(tuple(r) for r in scope.collect()) == [("c1", "d:d9"), ("c2", "u:u1")]
    assert sorted(tuple(r) for r in items.collect()) == [("d1", "d:d1"), ("d1", "u:u1"), ("d2", "d:d2"),
                                                         ("d3", "d:d3"), ("d3", "u:u2")]


def test_bucketed_append_prunes_stored_buckets(spark, scratch):
    schema = "k string, v int"
    target = f"{scratch}/t"
    big = spark.range(0, 2000).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v"))
    sinks.append_idempotent(big, target, ["k"], ["v"], key_buckets=32)
    b = [r[0] for r in spark.createDataFrame([("5",)], "k string").select(sinks.key_bucket(["k"], 32)).collect()]
    p = spark.read.parquet(target).filter(F.col("_kb").isin(b))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_kb" in p
    sinks.append_idempotent(spark.createDataFrame([("5", 1), ("new", 1)], schema), target, ["k"], ["v"], key_buckets=32)
    rows = spark.read.parquet(target)
    assert rows.count() == 2001 and rows.filter("k = '5'").first().v == 0


def test_store_chunks_rerun_is_idempotent(spark, scratch):
    from quire.operators.chunking import chunk_documents
    docs = spark.createDataFrame([("d1", "one. two. three"), ("d2", "alpha\n\nbeta")], "id string, text string")
    rows = sinks.chunk_rows(chunk_documents(docs), "2024-06-01 00:00:00", n_buckets=4)
    sinks.write_chunks(rows, f"{scratch}/chunks")
    sinks.write_chunks(rows, f"{scratch}/chunks")
    stored = spark.read.parquet(f"{scratch}/chunks")
    assert stored.count() == rows.count() == stored.select("id").distinct().count()


def test_positions_of_a_hot_group_within_one_minute(spark):
    """A third of all rows: one group, one minute, few time stamps."""
    from pyspark.sql import Window
    base = spark.range(0, 30_000, numPartitions=7)
    t = F.when(F.col("id") % 3 == 0, F.col("id") % 4).otherwise(F.pmod(F.xxhash64("id"), F.lit(10 ** 9)))
    df = base.select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None)
                     .otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("k"),
                     F.when(F.col("id") % 100 != 7, F.timestamp_micros(t.cast("long"))).alias("at"),
                     F.concat(F.lit("d"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000))).alias("d"), F.col("id"))
    for desc in (False, True):
        lead = F.col("at").desc_nulls_last() if desc else F.col("at").asc_nulls_first()
        order = [lead, "d", "id"]
        want = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(lead, "d", "id")).cast("long"))
        got = quantile_index(df, ["k"], order, F.unix_micros("at"), text_number(F.col("d")), lead_desc=desc, slice_rows=0, slices=64)
        assert got.count() == 30_000 and got.exceptAll(want).count() == 0
        few = quantile_index(df, ["k"], order, F.unix_micros("at"), lead_desc=desc, slice_rows=0, slices=8)
        assert few.exceptAll(want).count() == 0
    # the hot group is cut into slices of a few hundred rows
    from quire.functions import partitioning
    seen = []
    real = partitioning.ordered_index

    def spy(df, part, order, slice_by, **kw):
        seen.append(df.groupBy("k", slice_by.alias("s")).count().agg(F.max("count")).first()[0])
        return real(df, part, order, slice_by, **kw)
    partitioning.ordered_index = spy
    try:
        quantile_index(df, ["k"], ["at", "d", "id"], F.unix_micros("at"), text_number(F.col("d")), slice_rows=0, slices=64)
    finally:
        partitioning.ordered_index = real
    assert seen[0] <= 30_000 // 20
    assert quantile_index(df.limit(0), ["k"], ["at"], F.unix_micros("at"), slice_rows=0).count() == 0


def test_text_numbers_sort_as_texts(spark):
    texts = ["", "a", "ab", "abcdefg", "abcdefgh", "b", "é", "éa", "0", "10", "2", "\x01"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_number(F.col("t")).alias("n")).collect()
    by_text = [r.n for r in sorted(rows, key=lambda r: r.t.encode())]
    assert by_text == sorted(by_text) and len(set(by_text)) == len(texts) - 1


def test_search_scope_cells_of_one_large_owner(spark, monkeypatch):
    """One user with most conversations and documents: many cells, each pair
    once, whatever repeats in either table."""
    from quire.operators import lookup
    convs = spark.createDataFrame([(f"c{i}", "u" if i < 50 else f"v{i % 3}", ["d1"] if i % 9 == 0 else None) for i in range(60)]
                                  + [("c1", "u", None), ("c2", "v1", None), ("c3", "u", ["d7", "d7"]), (None, "u", ["d1"]), (None, "u", None), ("n", None, None)],
                                  "id string, user_id string, doc_ids array<string>")
    docs = spark.createDataFrame([(f"d{i}", "u" if i < 70 else f"v{i % 3}", "processed" if i % 4 else "failed") for i in range(90)]
                                 + [("d1", "u", "processed"), ("d1", "v1", "processed"), ("dn", None, "processed")], "id string, user_id string, status string")
    c, d = convs.collect(), docs.collect()
    want = {(x.id, y) for x in c for y in x.doc_ids or []}
    want |= {(x.id, y.id) for x in c if not x.doc_ids for y in d if y.status == "processed" and x.user_id is not None and x.user_id == y.user_id}
    assert lookup.CELL_ROWS ** 2 > 100_000
    whole = lookup.search_scope(convs, docs).collect()
    real = lookup._owned_pairs
    monkeypatch.setattr(lookup, "_owned_pairs", lambda a, b: real(a, b, cell_rows=8))
    cells = lookup.search_scope(convs, docs)
    for got in (whole, cells.collect()):
        assert len(got) == len(want) and {tuple(r) for r in got} == want
