"""Conversation windows and latest-state maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.partitioning import quantile_index
from quire.operators import versions


def last_messages(messages: DataFrame, n: int, conv: str = "conv_id") -> DataFrame:
    """The last ``n`` messages per conversation with ``pos`` 1..n in
    chronological order (``from_end`` 1 = newest). The limit is planned as a
    WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(conv).orderBy(F.col("created_at").desc(), F.col("turn").desc(), F.col("id").desc())
    m = messages.withColumn("from_end", F.row_number().over(w)).filter(F.col("from_end") <= n)
    cnt = F.count(F.lit(1)).over(Window.partitionBy(conv))
    return m.withColumn("pos", cnt - F.col("from_end") + 1)


def last_user_message(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The newest user message per conversation: ``(conv_id, turn, text)``.
    Conversations without a user message get no row (no retrieval)."""
    u = messages.filter(F.col("role") == "user")
    best = F.max_by(F.struct("turn", "text", "id"), F.struct("created_at", "turn", "id"))
    return u.groupBy(conv).agg(best.alias("_b")).select(
        conv, F.col("_b.turn").alias("turn"), F.col("_b.text").alias("text"), F.col("_b.id").alias("message_id"))


def exchanges(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Each user message with the next message when that is the
    assistant's reply (null when unanswered).

    ``lead`` as an equi-join on ``(conv_id, pos + 1)`` over skew-safe
    positions: the join key is unique per row, so a conversation holding a
    third of all messages still spreads over all tasks."""
    p = quantile_index(messages.select(conv, "created_at", "turn", "id", "role", "text"), [conv],
                       ["created_at", "turn", "id"], F.unix_micros("created_at"), F.col("turn").cast("long"))
    nxt = p.select(F.col(conv).alias("_c"), (F.col("pos") - 1).alias("_p"), F.col("role").alias("_next_role"),
                   F.col("text").alias("_next_text"), F.col("id").alias("_next_id"),
                   F.col("created_at").alias("_next_at"))
    users = p.filter(F.col("role") == "user")
    m = users.join(nxt, (users[conv] == nxt["_c"]) & (users["pos"] == nxt["_p"]), "left")
    answered = F.col("_next_role") == "assistant"
    return (m
            .select(users[conv], F.col("id").alias("user_message_id"), F.col("text").alias("question"),
                    F.col("created_at").alias("question_at"),
                    F.when(answered, F.col("_next_id")).alias("answer_id"),
                    F.when(answered, F.col("_next_text")).alias("answer"),
                    F.when(answered, F.col("_next_at")).alias("answer_at")))


def first_exchange_flag(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``messages_so_far`` and ``is_first_exchange`` (at most 2 so far);
    the running count is the skew-safe position."""
    p = quantile_index(messages, [conv], ["created_at", "turn", "id"], F.unix_micros("created_at"),
                       F.col("turn").cast("long"), out="messages_so_far")
    return p.withColumn("is_first_exchange", F.col("messages_so_far") <= 2)


def exchange_rows(ex: DataFrame, context_count: DataFrame | None = None, conv: str = "conv_id") -> DataFrame:
    """K3: an answered exchange as the two stored messages, user then
    assistant, content wrapped as ``{"text": ..}`` and metadata with the
    context count."""
    base = ex.filter(F.col("answer_id").isNotNull())
    if context_count is not None:
        base = base.join(context_count, conv, "left")
    else:
        base = base.withColumn("context_docs_count", F.lit(0))
    cnt = F.coalesce(F.col("context_docs_count"), F.lit(0)).cast("bigint")

    def meta(ts):
        return F.to_json(F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                                  cnt.alias("context_docs_count")))
    u = base.select(conv, F.col("user_message_id").alias("id"), F.lit("user").alias("role"),
                    F.to_json(F.struct(F.col("question").alias("text"))).alias("content"),
                    meta(F.col("question_at")).alias("metadata"))
    a = base.select(conv, F.col("answer_id").alias("id"), F.lit("assistant").alias("role"),
                    F.to_json(F.struct(F.col("answer").alias("text"))).alias("content"),
                    meta(F.col("answer_at")).alias("metadata"))
    return u.unionByName(a)


# ---------------------------------------------------------------- latest state

def add_documents(conversations: DataFrame, additions: DataFrame) -> DataFrame:
    """Append ``additions (conv_id, doc_id, seq)`` to ``doc_ids`` without
    duplicates; existing order kept, new ones in ``seq`` order."""
    # a document added many times counts once, at its first place
    once = additions.groupBy("conv_id", "doc_id").agg(F.min("seq").alias("seq"))
    add = (once.groupBy("conv_id")
           .agg(F.array_sort(F.collect_list(F.struct("seq", "doc_id"))).alias("_a"))
           .select(F.col("conv_id").alias("id"), F.transform("_a", lambda s: s["doc_id"]).alias("_new")))
    j = conversations.join(add, "id", "left")
    merged = F.array_union(F.coalesce(F.col("doc_ids"), F.array().cast("array<string>")),
                           F.coalesce(F.col("_new"), F.array().cast("array<string>")))
    return j.withColumn("doc_ids", F.when(F.size(merged) > 0, merged)).drop("_new")


def latest_status(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """U2 fold: newest ``(status, error)`` per key by ``(ts, seq)``; the
    aggregate is partial per map task, so a hot key never gathers its rows."""
    b = F.max_by(F.struct("status", "error", "ts", "seq"), F.struct("ts", "seq"))
    return log.groupBy(key).agg(b.alias("_b")).select(
        key, F.col("_b.status").alias("new_status"), F.col("_b.error").alias("error"),
        F.col("_b.ts").alias("status_ts"), F.col("_b.seq").alias("status_seq"))


def apply_status(documents: DataFrame, latest: DataFrame) -> DataFrame:
    """U2 apply: new status where a log entry exists; error into metadata."""
    j = documents.join(latest.withColumnRenamed("doc_id", "id"), "id", "left")
    return (j.withColumn("status", F.coalesce("new_status", "status"))
            .withColumn("metadata", F.to_json(F.struct(F.col("filename"), F.col("status"), F.col("error"))))
            .drop("new_status", "status_seq"))


def update_titles(conversations: DataFrame, titles: DataFrame) -> DataFrame:
    """Take ``new_title`` unless it is null or ``'New Conversation'``."""
    j = conversations.join(titles.select(F.col("id"), "new_title"), "id", "left")
    ok = F.col("new_title").isNotNull() & (F.col("new_title") != "New Conversation")
    return j.withColumn("title", F.when(ok, F.col("new_title")).otherwise(F.col("title"))).drop("new_title")


def delete_conversations(conversations: DataFrame, messages: DataFrame, requests: DataFrame,
                         soft: bool = False):
    """U4: remove requested conversations and their messages (anti-joins), or
    with ``soft`` mark them ``deleted`` and keep everything."""
    req = requests.select(F.col("id").alias("_rid")).distinct()
    if soft:
        c = conversations.join(req, conversations["id"] == req["_rid"], "left")
        c = c.withColumn("status", F.when(F.col("_rid").isNotNull(), F.lit("deleted"))
                         .otherwise(F.coalesce(F.col("status") if "status" in conversations.columns
                                               else F.lit(None), F.lit("active")))).drop("_rid")
        return c, messages
    c = conversations.join(req, conversations["id"] == req["_rid"], "left_anti")
    m = messages.join(req, messages["conv_id"] == req["_rid"], "left_anti")
    return c, m


def archive_split(conversations: DataFrame, cutoff: str) -> DataFrame:
    """``status`` archived when ``updated_at < cutoff`` else active."""
    return conversations.withColumn(
        "status", F.when(F.col("updated_at") < F.to_timestamp(F.lit(cutoff)), F.lit("archived"))
        .otherwise(F.lit("active")))


def apply_status_table(log: DataFrame, base: str):
    """U2 on the versioned documents table at ``base``: the newest status of
    each document in ``log`` is applied in one atomic step that rewrites only
    the buckets of those documents."""
    latest = latest_status(log).withColumnRenamed("doc_id", "id")

    def combine(docs: DataFrame, new: DataFrame) -> DataFrame:
        return apply_status(docs, new.withColumnRenamed("id", "doc_id"))
    return versions.merge(latest, base, ["id"], combine)


def archive_table(spark: SparkSession, base: str, cutoff: str):
    """U5 on the versioned conversations table at ``base``, in one atomic
    step."""
    return versions.rewrite(spark, base, lambda rows: archive_split(rows, cutoff))
