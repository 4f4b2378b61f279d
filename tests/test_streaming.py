import datetime as dt

from pyspark.sql import functions as F

from quire.streaming import jobs
from quire.views import Fixture

SF = "/root/testdata/sf0.001"


def test_ingest_multi_batch_with_restart_equals_batch(spark, scratch):
    fx = Fixture(spark, SF)
    docs = fx.documents().select("id", "user_id", "raw_path", "text")
    landing = f"{scratch}/landing"
    parts = [docs.filter(F.col("id").cast("int") % 4 == i) for i in range(4)]
    for i in range(2):
        parts[i].coalesce(1).write.parquet(f"{landing}/part{i}")
    schema = docs.schema
    target, ck = f"{scratch}/chunks", f"{scratch}/ck"
    jobs.stream_ingest(spark, f"{landing}/*", schema, target, ck)
    for i in range(2, 4):                 # more files land; restart from the checkpoint
        parts[i].coalesce(1).write.parquet(f"{landing}/part{i}")
    jobs.stream_ingest(spark, f"{landing}/*", schema, target, ck)
    jobs.stream_ingest(spark, f"{landing}/*", schema, target, ck)   # nothing new
    got = spark.read.parquet(target).select("doc_id", "chunk_index", "content")
    exp = jobs.ingest_batch(docs).select("doc_id", "chunk_index", "content")
    assert got.count() == exp.count()
    assert got.exceptAll(exp).count() == 0


def test_dedupe_drops_late_and_repeated(spark, scratch):
    t0 = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    b1 = [(1, t0 + dt.timedelta(minutes=100), 1, "click")]
    b2 = [(2, t0 + dt.timedelta(minutes=5), 2, "click"),      # late: older than the watermark
          (3, t0 + dt.timedelta(minutes=101), 1, "click"),    # repeat within the delay
          (4, t0 + dt.timedelta(minutes=200), 3, "view")]
    land = f"{scratch}/ev"
    spark.createDataFrame(b1, schema).coalesce(1).write.parquet(f"{land}/b1")
    src = jobs.file_stream(spark, f"{land}/*", spark.createDataFrame([], schema).schema, max_files=1)
    out = jobs.dedupe_stream(src, ["user_id", "event_type"])
    w = out.writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/ck")
    jobs.run_available(w)
    spark.createDataFrame(b2, schema).coalesce(1).write.parquet(f"{land}/b2")
    src = jobs.file_stream(spark, f"{land}/*", spark.createDataFrame([], schema).schema, max_files=1)
    out = jobs.dedupe_stream(src, ["user_id", "event_type"])
    w = out.writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/ck")
    jobs.run_available(w)
    assert sorted(r.event_id for r in spark.read.parquet(f"{scratch}/out").collect()) == [1, 4]


def test_conversation_state_across_batches_equals_window(spark, scratch):
    from quire.operators.dialogue import last_messages
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    fx = Fixture(spark, SF)
    msgs = fx.messages()
    land = f"{scratch}/msgs"
    msgs.filter("turn <= 3").coalesce(1).write.parquet(f"{land}/a")
    msgs.filter("turn > 3").coalesce(1).write.parquet(f"{land}/b")
    src = jobs.file_stream(spark, f"{land}/*", msgs.schema, max_files=1)
    out = f"{scratch}/state"

    def sink(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)

    jobs.run_available(jobs.conversation_state(src).writeStream.foreachBatch(sink)
                       .option("checkpointLocation", f"{scratch}/ck").outputMode("update"))
    res = spark.read.parquet(out)
    latest = res.groupBy("conv_id").agg(F.max("batch_id").alias("batch_id"))
    got = res.join(latest, ["conv_id", "batch_id"]).select("conv_id", "id", "pos")
    exp = last_messages(msgs, 10).select("conv_id", "id", F.col("pos").cast("long"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_raw_file_landing_ingest(spark, scratch):
    import os
    from plain import plain_chunks
    land = f"{scratch}/landing"
    os.makedirs(f"{land}/a")
    texts = {"a/one.txt": "First paragraph.\n\nSecond paragraph.", "a/two.MD": "x" * 2500 + ". end",
             "b.pdf": "%PDF binary", "c.exe": "MZ"}
    for name, body in list(texts.items())[:2]:
        with open(f"{land}/{name}", "w") as fh:
            fh.write(body)
    target, ck = f"{scratch}/chunks", f"{scratch}/ck"
    jobs.stream_ingest_files(spark, land, target, ck, user_id="u1", max_files=1)
    for name, body in list(texts.items())[2:]:
        with open(f"{land}/{name}", "w") as fh:
            fh.write(body)
    jobs.stream_ingest_files(spark, land, target, ck, user_id="u1")
    got = {}
    for r in spark.read.parquet(target).collect():
        got.setdefault(os.path.basename(r.raw_path), []).append((r.chunk_index, r.content))
    assert set(got) == {"one.txt", "two.MD", "b.pdf"}          # .exe not admitted
    assert [c for _, c in sorted(got["one.txt"])] == plain_chunks(texts["a/one.txt"])
    assert [c for _, c in sorted(got["two.MD"])] == plain_chunks(texts["a/two.MD"])
    assert sorted(got["b.pdf"])[0][1].startswith("[PDF Content] Filename: b.pdf")


def test_status_fold_multi_batch_and_replay(spark, scratch):
    from quire.operators import dialogue, versions
    from quire.plans.q_tables import _status_log
    ev = Fixture(spark, SF).table("events")
    land = f"{scratch}/ev"
    for i in range(3):
        ev.filter(F.col("event_id") % 3 == i).coalesce(1).write.parquet(f"{land}/p{i}")
    base = f"{scratch}/status"
    for ck in ("ck1", "ck2"):   # second run replays every batch from a fresh checkpoint
        src = jobs.file_stream(spark, f"{land}/*", ev.schema, max_files=1)
        jobs.run_available(_status_log(src).writeStream.foreachBatch(jobs.status_merge_sink(base, key_buckets=8))
                           .option("checkpointLocation", f"{scratch}/{ck}"))
    got = versions.read(spark, base).select("doc_id", "new_status", "error")
    exp = dialogue.latest_status(_status_log(ev)).select("doc_id", "new_status", "error")
    assert got.count() == exp.count()
    assert got.exceptAll(exp).count() == 0
