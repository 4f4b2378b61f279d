"""Scope, lookups and relational views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.partitioning import quantile_index, text_number

EMPTY_SCOPES = ("all", "none", "owned_processed")


def search_scope(conversations: DataFrame, documents: DataFrame,
                 empty_scope: str = "owned_processed") -> DataFrame:
    """``(conv_id, doc_id)`` documents a conversation may search.

    Its own ``doc_ids``; when empty, per ``empty_scope``: all processed
    documents of its user (default), every document, or none. Built as an
    explode plus an equi-join on ``user_id``, cut into cells of some million
    pairs (``_owned_pairs``). For ``all`` the conversation
    gets one row with a null ``doc_id`` meaning "the whole collection": the
    search then runs unscoped for it instead of pairing it with every
    document."""
    if empty_scope not in EMPTY_SCOPES:
        raise ValueError(f"empty_scope must be one of {EMPTY_SCOPES}")
    own = conversations.select(F.col("id").alias("conv_id"), F.explode("doc_ids").alias("doc_id"))
    empty = conversations.filter(F.size(F.coalesce("doc_ids", F.array().cast("array<string>"))) == 0)
    if empty_scope == "none":
        return own.distinct()
    if empty_scope == "all":
        rest = empty.select(F.col("id").alias("conv_id"), F.lit(None).cast("string").alias("doc_id"))
        return own.unionByName(rest).distinct()
    d = documents.filter((F.col("status") == "processed") & F.col("user_id").isNotNull()).select(F.col("id").alias("doc_id"), "user_id").distinct()
    e = empty.select(F.col("id").alias("conv_id"), "user_id").filter(F.col("user_id").isNotNull()).distinct()
    # pairs of a conversation that has one user and no documents of its own
    # can't repeat; only those of the others are compared
    owner = (e.withColumn("_own", F.lit(False)).unionByName(own.select("conv_id", F.lit(None).cast(e.schema["user_id"].dataType).alias("user_id"), F.lit(True).alias("_own")))
             .groupBy("conv_id").agg(F.min("user_id").alias("user_id"), F.max("user_id").alias("_last"), F.max("_own").alias("_own")))
    plain = ~F.col("_own") & (F.col("user_id") == F.col("_last"))
    simple = owner.filter(plain).select("conv_id", "user_id")
    mixed = owner.filter(F.col("user_id").isNotNull() & ~plain).select(F.col("conv_id").alias("_c"))
    others = e.join(mixed, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").join(d, "user_id").select("conv_id", "doc_id")
    return own.unionByName(others).distinct().unionByName(_owned_pairs(simple, d))


#: Conversations, and documents, of one user that meet in a cell at most.
CELL_ROWS = 1024


def _owned_pairs(convs: DataFrame, docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(conv_id, doc_id)`` of equal ``user_id``. The rows of a user are cut
    into blocks on both sides, so that one who owns many conversations and
    documents becomes many cells of bounded output, dealt to as many tasks as
    the output needs."""
    size = (convs.groupBy("user_id").agg(F.count(F.lit(1)).alias("_nc"))
            .join(docs.groupBy("user_id").agg(F.count(F.lit(1)).alias("_nd")), "user_id"))
    pairs = size.agg(F.sum(F.col("_nc") * F.col("_nd"))).first()[0] or 0
    tasks = pairs // (cell_rows * cell_rows)
    if tasks < 2:
        return convs.join(docs, "user_id").select("conv_id", "doc_id")
    size = size.select("user_id", *[F.ceil(F.col(n) / cell_rows).cast("int").alias(b) for n, b in (("_nc", "_cs"), ("_nd", "_ds"))])
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, min(tasks, 20_000))

    def cut(df, key, mine, theirs, here, there):
        return (df.join(size, "user_id").withColumn(here, F.pmod(F.xxhash64(key), F.col(mine)).cast("int"))
                .withColumn(there, F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))).drop("_cs", "_ds")
                .repartition(2 * tasks, "user_id", "_cb", "_db"))

    left, right = cut(convs, "conv_id", "_cs", "_ds", "_cb", "_db"), cut(docs, "doc_id", "_ds", "_cs", "_db", "_cb")
    return left.join(right.hint("shuffle_hash"), ["user_id", "_cb", "_db"]).select("conv_id", "doc_id")


def search_scope_keys(conversations: DataFrame, documents: DataFrame,
                      empty_scope: str = "owned_processed") -> tuple[DataFrame, DataFrame]:
    """T1 in compact form for the search: ``(scope, item_keys)``.

    ``scope`` is ``(conv_id, scope_key)`` with ``d:<doc_id>`` for a listed
    document and ``u:<user_id>`` for "all processed documents of the user";
    ``item_keys`` is ``(doc_id, scope_key)`` listing every document under its
    own key and, when processed, under its owner's key. The search joins
    items to scopes on the key, so an empty conversation is never expanded
    into one row per document of its user (a user owning a third of all
    documents becomes one key, split into blocks by the search)."""
    if empty_scope not in EMPTY_SCOPES:
        raise ValueError(f"empty_scope must be one of {EMPTY_SCOPES}")
    own = conversations.select(F.col("id").alias("conv_id"),
                               F.explode(F.transform("doc_ids", lambda d: F.concat(F.lit("d:"), d))).alias("scope_key"))
    empty = conversations.filter(F.size(F.coalesce("doc_ids", F.array().cast("array<string>"))) == 0)
    items = documents.select(F.col("id").alias("doc_id"), F.concat(F.lit("d:"), F.col("id")).alias("scope_key"))
    if empty_scope == "owned_processed":
        rest = empty.select(F.col("id").alias("conv_id"), F.concat(F.lit("u:"), F.col("user_id")).alias("scope_key"))
        owned = documents.filter(F.col("status") == "processed").select(
            F.col("id").alias("doc_id"), F.concat(F.lit("u:"), F.col("user_id")).alias("scope_key"))
        return own.unionByName(rest).distinct(), items.unionByName(owned)
    if empty_scope == "all":
        rest = empty.select(F.col("id").alias("conv_id"), F.lit("*").alias("scope_key"))
        return own.unionByName(rest).distinct(), items.unionByName(
            documents.select(F.col("id").alias("doc_id"), F.lit("*").alias("scope_key")))
    return own.distinct(), items


def user_documents(documents: DataFrame) -> DataFrame:
    """Documents per user newest first, ``pos`` 1-based (skew-safe: a
    user owning a third of all documents is numbered by many tasks)."""
    return quantile_index(documents, ["user_id"], [F.col("created_at").desc(), F.col("id")],
                          F.unix_micros("created_at"), text_number(F.col("id")), lead_desc=True)


def owned_lookup(requests: DataFrame, table: DataFrame, id_col: str = "id") -> DataFrame:
    """A row is found only if id **and** user match (owner isolation);
    requests without a match get ``found`` false."""
    t = table.select(F.col(id_col).alias("_id"), F.col("user_id").alias("_uid"),
                     *[F.col(c) for c in table.columns if c not in (id_col, "user_id")])
    j = requests.join(t, (requests["req_id"] == t["_id"]) & (requests["req_user"] == t["_uid"]), "left")
    return j.withColumn("found", F.col("_id").isNotNull()).drop("_id", "_uid")


def document_view(documents: DataFrame) -> DataFrame:
    """T4: ``filename`` and ``status`` read from the metadata JSON with
    default ``Unknown``; ISO-8601 creation time or ``Unknown``."""
    iso = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return documents.select(
        "id",
        F.coalesce(F.get_json_object("metadata", "$.filename"), F.lit("Unknown")).alias("filename"),
        F.coalesce(F.get_json_object("metadata", "$.status"), F.lit("Unknown")).alias("status"),
        F.coalesce(iso, F.lit("Unknown")).alias("created_at"))


def user_conversations(conversations: DataFrame, n: int = 15) -> DataFrame:
    """T5: per user the ``n`` most recent conversations (the limit is the
    feature), with ``document_count`` (0 when null)."""
    w = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), F.col("id"))
    return (conversations.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
            .withColumn("document_count", F.size(F.coalesce("doc_ids", F.array().cast("array<string>")))))


def conversation_documents(conversations: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per listed document of a conversation, in list order, with
    its name (null when the id is unknown; conversations without documents
    keep one row with nulls)."""
    e = conversations.select(F.col("id").alias("conv_id"), F.posexplode_outer("doc_ids").alias("pos", "doc_id"))
    return e.join(documents.select(F.col("id").alias("doc_id"), "filename"), "doc_id", "left")


def conversation_messages(messages: DataFrame) -> DataFrame:
    """Messages of each conversation with their order ``pos`` (skew-safe)."""
    return quantile_index(messages, ["conv_id"], ["created_at", "turn", "id"], F.unix_micros("created_at"),
                          F.col("turn").cast("long"))


def processing_completion(documents: DataFrame, parsed_rows: DataFrame) -> DataFrame:
    """For every document, parsed rows for its ``(raw_path, user_id)``:
    ``total_chunks`` and ``completed``. The parsed side is aggregated before
    the join (one row per path)."""
    n = parsed_rows.groupBy("path", "user_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    j = documents.join(n, (documents["raw_path"] == n["path"]) & (documents["user_id"] == n["user_id"]), "left")
    return j.select(documents["id"], F.coalesce("total_chunks", F.lit(0)).cast("bigint").alias("total_chunks"),
                    (F.coalesce("total_chunks", F.lit(0)) > 0).alias("completed"))


def user_exists(requests: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """``exists`` per requested user id."""
    u = users.select(F.col("id").alias("_uid")).distinct().withColumn("_e", F.lit(True))
    return (requests.join(u, requests[key] == u["_uid"], "left")
            .withColumn("exists", F.coalesce("_e", F.lit(False))).drop("_uid", "_e"))


FAILED_CONTENT = "Failed to process document content"


def processing_result(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """A1: per document ``chunks_created``, ``total_tokens``, ``total_length``
    and final status (``failed`` with an error when no chunk came out)."""
    a = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks_created"),
                                     F.sum("token_count").alias("total_tokens"),
                                     F.sum("chunk_length").alias("total_length"))
    j = documents.select(F.col("id").alias("doc_id")).join(a, "doc_id", "left")
    n = F.coalesce("chunks_created", F.lit(0))
    return j.select("doc_id", n.cast("bigint").alias("chunks_created"),
                    F.coalesce("total_tokens", F.lit(0)).cast("bigint").alias("total_tokens"),
                    F.coalesce("total_length", F.lit(0)).cast("bigint").alias("total_length"),
                    F.when(n > 0, F.lit("processed")).otherwise(F.lit("failed")).alias("status"),
                    F.when(n == 0, F.lit(FAILED_CONTENT)).alias("error"))


DOC_STATUSES = ("uploaded", "processing", "processed", "failed")
ROLES = ("user", "assistant", "system")


def user_counts(documents: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """A2: per user documents by status, conversations, messages by role.

    Pivots use the fixed value lists, so no extra pass discovers them."""
    d = documents.groupBy("user_id").pivot("status", list(DOC_STATUSES)).count()
    d = d.select("user_id", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(f"docs_{s}") for s in DOC_STATUSES])
    c = conversations.groupBy("user_id").agg(F.count(F.lit(1)).cast("bigint").alias("conversations"))
    m = (messages.join(conversations.select(F.col("id").alias("conv_id"), "user_id"), "conv_id")
         .groupBy("user_id").pivot("role", list(ROLES)).count())
    m = m.select("user_id", *[F.coalesce(F.col(r), F.lit(0)).cast("bigint").alias(f"msgs_{r}") for r in ROLES])
    users = d.select("user_id").union(c.select("user_id")).distinct()
    out = users.join(d, "user_id", "left").join(c, "user_id", "left").join(m, "user_id", "left")
    return out.fillna(0)
