"""Structured Streaming jobs (ST1-ST6).

Every job is the batch operator applied to a stream: the same DataFrame
functions run per micro-batch (or in a stateful operator), checkpoints make
them resumable, and keyed sinks make replays harmless. Tests and the named
queries drive them with ``trigger(availableNow=True)``; on a cluster the same
code runs with a processing-time trigger.

State and output folders are always taken under the folder the session names
in ``spark.checkpoint.dir`` (see ``quire.session.checkpoint_path``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from quire.operators import chunking, dialogue, keyed, sinks, versions
from quire.sources import files

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """New Parquet files below ``path`` as a stream (declared schema)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(path)


def run_available(writer) -> None:
    """Start a ``DataStreamWriter`` with ``availableNow`` and wait until all
    that is available has been processed; a failed stream raises."""
    q = writer.trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()


# ---------------------------------------------------------------- ST1 / ST2

def ingest_batch(docs: DataFrame, size: int = chunking.DEFAULT_CHUNK_SIZE) -> DataFrame:
    """S3 -> S4 -> C2/C3 -> C5 for landed document rows
    ``(id, user_id, raw_path, text)``: only admitted files are chunked."""
    adm = files.admit(docs.withColumn("length", F.octet_length("text")), "raw_path", "length") \
        .filter(F.col("admitted"))
    fname = F.regexp_extract("raw_path", "([^/]*)$", 1)
    ext = adm.select("id", "user_id", "raw_path",
                     files.extract_text(F.encode("text", "UTF-8"), fname).alias("extracted"))
    ext = chunking.with_simple_chunks(ext.select(F.col("id").alias("doc_id"), "user_id", "raw_path", "extracted"),
                                      "extracted", "_chunks", size)
    ch = chunking.explode_chunks(ext, F.col("_chunks"), ["doc_id", "user_id", "raw_path"])
    return ch.withColumn("chunk_id", sinks.stable_id(F.col("doc_id"), F.col("chunk_index")))


def keyed_append_sink(target: str, key: list[str], order: list[str], key_buckets: int | None = 64):
    """ST2: ``foreachBatch`` function appending only unseen keys (K1).

    A replayed batch (after a failure between write and commit) finds its
    keys stored and appends nothing, so the table holds each key once. The
    table is laid out by key bucket so each batch reads only its buckets."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        sinks.append_idempotent(batch, target, key, order, key_buckets=key_buckets)
    return sink


def bucketed_append_sink(target: str, key: list[str], order: list[str], buckets: int | None = None):
    """ST2 on a bucketed table (``quire.operators.keyed``): only unseen keys
    are appended, and the stored keys are neither shuffled nor, for a batch of
    usual size, sorted."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        keyed.append(batch, target, key, order, buckets)
    return sink


def binary_file_stream(spark: SparkSession, landing: str, glob: str | None = None,
                       max_files: int | None = None) -> DataFrame:
    """New raw files in a landing folder as ``(path, modificationTime,
    length, content)`` rows (the binaryFile source, streaming)."""
    schema = T.StructType([T.StructField("path", T.StringType()),
                           T.StructField("modificationTime", T.TimestampType()),
                           T.StructField("length", T.LongType()),
                           T.StructField("content", T.BinaryType())])
    r = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(landing)


def ingest_files(files_df: DataFrame, user_id: str | None = None,
                 size: int = chunking.DEFAULT_CHUNK_SIZE) -> DataFrame:
    """S3 -> S4 -> C2/C3 -> C5 for raw file rows from ``binaryFile``: the
    document id is the content key (user, SHA-256 prefix) so a re-landed
    file maps to the same chunks."""
    f = files_df.withColumn("path", F.regexp_replace("path", "^file:", ""))
    adm = files.admit(f, "path", "length").filter(F.col("admitted"))
    fname = F.regexp_extract("path", "([^/]*)$", 1)
    uid = F.lit(user_id) if user_id is not None else F.lit(None).cast("string")
    ext = adm.select(F.concat_ws("_", uid, files.content_hash(F.col("content"))).alias("doc_id"),
                     uid.alias("user_id"), F.col("path").alias("raw_path"),
                     files.extract_text(F.col("content"), fname).alias("extracted"))
    ext = chunking.with_simple_chunks(ext, "extracted", "_chunks", size)
    ch = chunking.explode_chunks(ext, F.col("_chunks"), ["doc_id", "user_id", "raw_path"])
    return ch.withColumn("chunk_id", sinks.stable_id(F.col("doc_id"), F.col("chunk_index")))


def stream_ingest_files(spark: SparkSession, landing: str, target: str, checkpoint: str,
                        user_id: str | None = None, max_files: int | None = 10) -> None:
    """ST1 over raw files: every new file in ``landing`` is admitted,
    extracted, chunked and appended once to the chunk table."""
    src = binary_file_stream(spark, landing, max_files=max_files)
    run_available(ingest_files(src, user_id).writeStream.foreachBatch(
        keyed_append_sink(target, ["chunk_id"], ["chunk_index"])).option("checkpointLocation", checkpoint))


def stream_ingest(spark: SparkSession, landing: str, schema: T.StructType, target: str,
                  checkpoint: str, glob: str | None = None, max_files: int | None = 1) -> None:
    """ST1: continuous ingest of landed files into the chunk table."""
    src = file_stream(spark, landing, schema, glob, max_files)
    out = ingest_batch(src)
    run_available(out.writeStream.foreachBatch(
        keyed_append_sink(target, ["chunk_id"], ["chunk_index"])).option("checkpointLocation", checkpoint))


# ---------------------------------------------------------------- ST3

def dedupe_stream(events: DataFrame, key: list[str], delay: str = "10 minutes",
                  ts: str = "ts") -> DataFrame:
    """ST3: drop repeats of ``key`` arriving within the watermark delay."""
    return (events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
            .dropDuplicatesWithinWatermark(key))


# ---------------------------------------------------------------- ST4

TIMEOUT_MESSAGE = "failed: AI parsing timeout"


def completion_join(requests: DataFrame, completions: DataFrame, timeout: str = "300 seconds",
                    delay: str = "10 minutes", key: str = "user_id", salts: int = 1) -> DataFrame:
    """ST4: each request with the completions of the same key inside
    ``[ts, ts + timeout]`` (left outer interval join). Unmatched requests are
    emitted once the watermark passes their window.

    ``salts > 1`` spreads a hot key's join state over that many tasks: each
    completion gets one salt (hash of its id) and each request is replicated
    over all salts. A request then yields one row per salt without a match;
    ``completion_status`` collapses them (earliest match wins)."""
    r = (requests.select(F.col("event_id").alias("req_id"), F.col(key).alias("r_key"),
                         F.col("ts").cast("timestamp").alias("req_ts"))
         .withWatermark("req_ts", delay))
    c = (completions.select(F.col("event_id").alias("done_id"), F.col(key).alias("c_key"),
                            F.col("ts").cast("timestamp").alias("done_ts"))
         .withWatermark("done_ts", delay))
    cond = ((F.col("r_key") == F.col("c_key")) & (F.col("done_ts") >= F.col("req_ts"))
            & (F.col("done_ts") <= F.col("req_ts") + F.expr(f"interval {timeout}")))
    if salts > 1:
        r = r.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        c = c.withColumn("c_salt", F.pmod(F.xxhash64("done_id"), F.lit(salts)).cast("int"))
        cond = cond & (F.col("r_salt") == F.col("c_salt"))
    return r.join(c, cond, "leftOuter").select("req_id", "r_key", "req_ts", "done_id", "done_ts")


def completion_status(pairs: DataFrame) -> DataFrame:
    """Earliest completion per request, or the timeout status (batch over
    the join's output)."""
    # order by (time, id) for matched rows; unmatched rows (null) never win
    first = F.min_by(F.struct("done_id", "done_ts"),
                     F.when(F.col("done_ts").isNotNull(), F.struct("done_ts", "done_id")))
    g = pairs.groupBy("req_id").agg(first.alias("_f"))
    return g.select("req_id", F.col("_f.done_id").alias("done_id"),
                    F.when(F.col("_f.done_id").isNotNull(), F.lit("completed"))
                    .otherwise(F.lit(TIMEOUT_MESSAGE)).alias("status"))


# ---------------------------------------------------------------- ST5

MSG_STATE = T.StructType([T.StructField("created_at", T.TimestampType()), T.StructField("turn", T.LongType()),
                          T.StructField("id", T.StringType()), T.StructField("role", T.StringType()),
                          T.StructField("text", T.StringType())])
ST5_OUT = T.StructType([T.StructField("conv_id", T.StringType()), T.StructField("id", T.StringType()),
                        T.StructField("pos", T.LongType()), T.StructField("role", T.StringType()),
                        T.StructField("last_retrieval", T.TimestampType()), T.StructField("seq", T.LongType())])


class ConversationState(StatefulProcessor):
    """ST5: per conversation, the last ``keep`` messages (ListState, bounded)
    and the time of the last user message (when retrieval last ran). Emits
    the current window on every update, numbered by ``seq``."""

    keep = 10

    def init(self, handle) -> None:
        self.msgs = handle.getListState("messages", MSG_STATE)
        self.seq = handle.getValueState("updates", T.StructType([T.StructField("n", T.LongType())]))
        self.last = handle.getValueState("last_retrieval", T.StructType([T.StructField("ts", T.TimestampType())]))

    def handleInputRows(self, key, rows, timerValues):
        cur = [tuple(r) for r in self.msgs.get()] if self.msgs.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        for pdf in rows:
            users = pdf.loc[pdf["role"] == "user", "created_at"]
            if len(users):
                t = pd.Timestamp(users.max()).to_pydatetime()
                last = t if last is None or t > last else last
            # only the batch's newest rows can enter the window
            new = pdf.sort_values(["created_at", "turn", "id"]).tail(self.keep)
            for r in new[["created_at", "turn", "id", "role", "text"]].itertuples(index=False, name=None):
                cur.append((pd.Timestamp(r[0]).to_pydatetime(), int(r[1]), r[2], r[3], r[4]))
            cur = sorted(cur, key=lambda m: (m[0], m[1], m[2]))[-self.keep:]
        self.msgs.clear()
        self.msgs.put(cur)
        if last is not None:
            self.last.update((last,))
        seq = (self.seq.get()[0] if self.seq.exists() else 0) + 1
        self.seq.update((seq,))
        yield pd.DataFrame({"conv_id": [key[0]] * len(cur), "id": [m[2] for m in cur],
                            "pos": list(range(1, len(cur) + 1)), "role": [m[3] for m in cur],
                            "last_retrieval": [last] * len(cur), "seq": [seq] * len(cur)})

    def close(self) -> None:
        pass


def conversation_state(messages: DataFrame) -> DataFrame:
    """ST5 stream: ``(conv_id, id, pos, role, last_retrieval, seq)`` updates;
    of a conversation's windows the one with the largest ``seq`` is current.
    Needs the RocksDB state store provider set on the session first."""
    return (messages.groupBy("conv_id")
            .transformWithStateInPandas(statefulProcessor=ConversationState(), outputStructType=ST5_OUT,
                                        outputMode="Update", timeMode="None"))


# ---------------------------------------------------------------- ST6

def status_merge_sink(base: str, key_buckets: int = 64, keep: int = 3):
    """ST6: ``foreachBatch`` folding a status-log batch into the current
    status table, a versioned table at ``base`` (``quire.operators.versions``)
    laid out by a hash bucket of the key.

    Only the buckets the batch touches are read, merged (newest by
    ``(ts, seq)``) and written, to a folder of the batch's own; renaming one
    manifest makes the change. A job that dies before leaves the old table,
    one that dies after leaves the new one, and since the merge is a max-by
    fold a replayed batch changes nothing. ``keep`` versions stay."""
    def combine(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return dialogue.latest_status(stored.unionByName(batch).withColumnsRenamed(
            {"new_status": "status", "status_ts": "ts", "status_seq": "seq"}))

    def sink(batch: DataFrame, batch_id: int) -> None:
        got = versions.merge(dialogue.latest_status(batch), base, ["doc_id"], combine, buckets=key_buckets)
        if got is not None and got.number % (2 * keep) == 0:
            versions.vacuum(batch.sparkSession, base, keep)
    return sink
