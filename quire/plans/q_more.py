"""Sink and quality queries: K1-K5, Q1-Q7."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import NON_WS
from quire.operators import dialogue, quality, sinks
from quire.operators.chunking import chunk_documents
from quire.plans.catalog import register
from quire.plans.q_text import chunk_oracle
from quire.views import Fixture, duck_cte

# ---------------------------------------------------------------- K


def _keyed_pages(fx):
    docs = fx.documents().select(F.col("id").cast("bigint").alias("doc_id"), F.col("raw_path").alias("path"),
                                 "user_id")
    return fx.pages().join(docs, "doc_id").select(
        "path", "user_id", F.col("page_id").cast("string").alias("page_id"),
        F.col("content").alias("text"), F.lit(0).alias("ord"))


_K1_SQL = duck_cte("v_pages", "v_documents") + """
select d.raw_path as path, d.user_id, cast(p.page_id as varchar) as page_id,
       cast(length(p.content) as bigint) as text_length
from v_pages p join v_documents d on d.id = cast(p.doc_id as varchar) where p.page_id % 2 = 1
"""


@register("k1_idempotent_append", _K1_SQL)
def k1_idempotent_append(spark, sf_dir):
    """K1: rows an insert-or-ignore on (path, user_id, page_id) adds: stored
    = even pages; batch = all pages plus a later duplicate of page 1."""
    pages = _keyed_pages(Fixture(spark, sf_dir))
    existing = pages.filter(F.col("page_id").cast("int") % 2 == 0)
    dups = pages.filter(F.col("page_id") == "1").withColumn("text", F.lit("dup")).withColumn("ord", F.lit(1))
    new = sinks.rows_to_append(pages.unionByName(dups), existing, ["path", "user_id", "page_id"], ["ord"])
    return new.select("path", "user_id", "page_id", F.length("text").cast("bigint").alias("text_length"))


_K2_SQL = chunk_oracle() + """
select sha256(doc_id || ':' || cast(chunk_index as varchar)) as id, doc_id, chunk_index,
       cast(len(regexp_extract_all(content, '""" + NON_WS + """+')) as bigint) as token_count,
       '2024-06-01 00:00:00' as created_at
from chunks
"""


@register("k2_store_chunks", _K2_SQL)
def k2_store_chunks(spark, sf_dir):
    """K2: the stored-chunk projection with deterministic ids."""
    ch = chunk_documents(Fixture(spark, sf_dir).documents())
    rows = sinks.chunk_rows(ch, "2024-06-01 00:00:00")
    return rows.select("id", "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                       F.col("token_count").cast("bigint").alias("token_count"),
                       F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


_K3_SQL = duck_cte("v_messages", "v_conversations_core") + """
, ex as (
  select * from (select conv_id, id, text, role,
        lead(role) over w as next_role, lead(text) over w as next_text, lead(id) over w as next_id
      from v_messages window w as (partition by conv_id order by created_at, turn, id))
  where role = 'user' and next_role = 'assistant'
)
select e.conv_id, e.id, 'user' as role, e.text, cast(c.n_docs as bigint) as context_docs_count
from ex e join v_conversations_core c on c.id = e.conv_id
union all
select e.conv_id, e.next_id as id, 'assistant' as role, e.next_text as text, cast(c.n_docs as bigint) as context_docs_count
from ex e join v_conversations_core c on c.id = e.conv_id
"""


@register("k3_exchange_rows", _K3_SQL)
def k3_exchange_rows(spark, sf_dir):
    """K3: every answered exchange as two stored messages with JSON content."""
    fx = Fixture(spark, sf_dir)
    ctx = fx.conversations().select(F.col("id").alias("conv_id"),
                                    F.size(F.coalesce("doc_ids", F.array().cast("array<string>"))).alias("context_docs_count"))
    rows = dialogue.exchange_rows(dialogue.exchanges(fx.messages()), ctx)
    return rows.select("conv_id", "id", "role", F.get_json_object("content", "$.text").alias("text"),
                       F.get_json_object("metadata", "$.context_docs_count").cast("bigint").alias("context_docs_count"))


_K4_SQL = duck_cte("v_users") + """
, req as (
  select distinct cast(user_id as varchar) as req_id, cast(null as varchar) as req_username from events
  union all select distinct cast(null as varchar), 'Customer#' || lpad(cast(user_id as varchar), 9, '0') from events
  union all select distinct cast(null as varchar), 'guest_' || cast(user_id as varchar) from events
)
select r.req_id, r.req_username, coalesce(a.id, b.id, substr(sha256(r.req_username), 1, 16)) as user_id,
       coalesce(a.id, b.id) is null as created
from req r left join v_users a on a.id = r.req_id left join v_users b on b.username = r.req_username
"""


@register("k4_get_or_create_users", _K4_SQL)
def k4_get_or_create_users(spark, sf_dir):
    """K4: resolve users by id, else by name, else create."""
    fx = Fixture(spark, sf_dir)
    u = fx.table("events").select(F.col("user_id").cast("string").alias("u")).distinct()
    inc = (u.select(F.col("u").alias("id"), F.lit(None).cast("string").alias("username"))
           .unionByName(u.select(F.lit(None).cast("string").alias("id"),
                                 F.concat(F.lit("Customer#"), F.lpad("u", 9, "0")).alias("username")))
           .unionByName(u.select(F.lit(None).cast("string").alias("id"),
                                 F.concat(F.lit("guest_"), F.col("u")).alias("username"))))
    return sinks.resolve_users(inc, fx.users())


_K5_SQL = duck_cte("v_messages", "v_conversations_core") + """
select distinct id from (
  select conv_id as id from v_messages union all select 'c' || cast(user_id as varchar) from events
) where id not in (select id from v_conversations_core)
"""


@register("k5_get_or_create_conversations", _K5_SQL)
def k5_get_or_create_conversations(spark, sf_dir):
    """K5: incoming conversation ids not stored yet (to create)."""
    fx = Fixture(spark, sf_dir)
    inc = (fx.messages().select(F.col("conv_id").alias("id"), F.col("turn").alias("seq"))
           .unionByName(fx.table("events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("id"),
                                                  F.col("event_id").alias("seq"))))
    return sinks.new_conversations(inc, fx.conversations()).select("id")


# ---------------------------------------------------------------- Q

_PK = [("documents", ["doc_id"]), ("embeddings", ["vec_id"]), ("labels", ["doc_id"]),
       ("events", ["event_id"]), ("conversations", ["conv_id", "turn"]), ("customer", ["c_custkey"]),
       ("pages", ["page_id"]), ("benchmark", ["item_id"])]


def _q1_sql() -> str:
    parts = []
    for t, key in _PK:
        k = ", ".join(key)
        nulls = " or ".join(f"{c} is null" for c in key)
        parts.append(f"select '{t}' as \"table\", 'pk_duplicate' as \"check\", "
                     f"(select count(*) from (select {k} from {t} group by {k} having count(*) > 1)) as violations")
        parts.append(f"select '{t}', 'pk_null', (select count(*) from {t} where {nulls})")
    return "select \"table\", \"check\", cast(violations as bigint) as violations from (" + \
        "\nunion all\n".join(parts) + ")"


@register("q1_primary_keys", _q1_sql())
def q1_primary_keys(spark, sf_dir):
    """Q1: duplicate and null primary keys over the driver's tables."""
    fx = Fixture(spark, sf_dir)
    checks = {}
    for t, key in _PK:
        df = fx.table(t)
        checks[(t, "pk_duplicate")] = quality.duplicate_keys(df, key)
        checks[(t, "pk_null")] = quality.null_keys(df, key)
    return quality.summary(checks).withColumn("violations", F.col("violations").cast("bigint"))


_Q2_SQL = duck_cte("v_documents") + """
select sha256(text) as text_hash, cast(count(*) as bigint) as n from v_documents group by text having count(*) > 1
"""


@register("q2_unique_text", _Q2_SQL)
def q2_unique_text(spark, sf_dir):
    """Q2: documents whose text is not unique (duplicate-content groups)."""
    d = Fixture(spark, sf_dir).documents().select(F.sha2("text", 256).alias("text_hash"))
    return quality.duplicate_keys(d, ["text_hash"]).withColumn("n", F.col("n").cast("bigint"))


_Q3_SQL = duck_cte("v_conv_docs", "v_documents", "v_users") + """
select 'conversation_documents' as child, doc_id as key from v_conv_docs
  where doc_id not in (select id from v_documents)
union all
select 'labels', cast(doc_id as varchar) from labels where doc_id not in (select doc_id from documents)
union all
select 'documents.user_id', id from v_documents where user_id not in (select id from v_users)
"""


@register("q3_foreign_keys", _Q3_SQL)
def q3_foreign_keys(spark, sf_dir):
    """Q3: child rows whose reference has no parent."""
    fx = Fixture(spark, sf_dir)
    docs = fx.documents()
    a = quality.orphans(fx.conv_docs(), "doc_id", docs, "id").select(
        F.lit("conversation_documents").alias("child"), F.col("doc_id").alias("key"))
    b = quality.orphans(fx.table("labels"), "doc_id", fx.table("documents"), "doc_id").select(
        F.lit("labels").alias("child"), F.col("doc_id").cast("string").alias("key"))
    c = quality.orphans(docs, "user_id", fx.users(), "id").select(
        F.lit("documents.user_id").alias("child"), F.col("id").alias("key"))
    return a.unionByName(b).unionByName(c)


_Q4_SQL = """
select 'documents' as "table", "column", cast(nulls as bigint) as nulls from (
  select 'text' as "column", count(*) filter (where text is null) as nulls from documents
  union all select 'lang', count(*) filter (where lang is null) from documents
  union all select 'source', count(*) filter (where source is null) from documents
  union all select 'n_chars', count(*) filter (where n_chars is null) from documents)
union all
select 'conversations', "column", cast(nulls as bigint) from (
  select 'role' as "column", count(*) filter (where role is null) as nulls from conversations
  union all select 'text', count(*) filter (where text is null) from conversations)
"""


@register("q4_not_null", _Q4_SQL)
def q4_not_null(spark, sf_dir):
    """Q4: null counts of required columns, one pass per table."""
    fx = Fixture(spark, sf_dir)
    d = quality.null_counts(fx.table("documents"), ["text", "lang", "source", "n_chars"]) \
        .select(F.lit("documents").alias("table"), "column", F.col("nulls").cast("bigint").alias("nulls"))
    c = quality.null_counts(fx.table("conversations"), ["role", "text"]) \
        .select(F.lit("conversations").alias("table"), "column", F.col("nulls").cast("bigint").alias("nulls"))
    return d.unionByName(c)


_Q5_SQL = """
select event_id, event_type, 'value not allowed' as reason from events
where event_type not in ('signup', 'click', 'view', 'purchase')
union all
select turn, role, 'value not allowed' from conversations where role not in ('user', 'assistant', 'system')
"""


@register("q5_domain", _Q5_SQL)
def q5_domain(spark, sf_dir):
    """Q5: values outside their allowed set (or longer than 20 for roles)."""
    fx = Fixture(spark, sf_dir)
    e = quality.domain_violations(fx.table("events"), "event_type", ["signup", "click", "view", "purchase"])
    m = quality.domain_violations(fx.table("conversations"), "role", ["user", "assistant", "system"], 20)
    return (e.select("event_id", "event_type", "reason")
            .unionByName(m.select(F.col("turn").alias("event_id"), F.col("role").alias("event_type"), "reason")))


EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("source", T.StringType()),
])

_Q6_SQL = """
select cast(event_id as varchar) as row_key, 'value' as "column", 'n/a' as value
from events where event_id % 17 = 0
"""


@register("q6_conform", _Q6_SQL)
def q6_conform(spark, sf_dir):
    """Q6: events as strings (every 17th value unreadable) conformed to the
    declared schema; returns the set-aside cells."""
    ev = Fixture(spark, sf_dir).table("events")
    raw = ev.select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("string").alias("ts"),
                    F.col("user_id").cast("string").alias("user_id"), "event_type",
                    F.when(F.col("event_id") % 17 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
                    .alias("value"), F.col("props").alias("extra"))
    _, aside = quality.conform(raw, EVENT_SCHEMA)
    return aside


_Q7_SQL = """
select cast(len(embedding) as int) as width, cast(count(*) as bigint) as rows,
  cast(count(*) filter (where embedding is null) as bigint) as nulls,
  cast(count(*) filter (where list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0) as bigint) as zero_norm,
  cast(count(*) filter (where list_bool_or(list_transform(embedding, lambda x: isnan(x) or isinf(x)))) as bigint) as non_finite,
  cast(case when len(embedding) <> 64 then count(*) else 0 end as bigint) as wrong_width
from embeddings group by len(embedding)
"""


@register("q7_vector_checks", _Q7_SQL)
def q7_vector_checks(spark, sf_dir):
    """Q7: vector width, nulls, zero norm and non-finite counts."""
    v = quality.vector_checks(Fixture(spark, sf_dir).table("embeddings"), "embedding", width=64)
    return v.select(F.col("width").cast("int").alias("width"),
                    *[F.col(c).cast("bigint").alias(c) for c in ("rows", "nulls", "zero_norm", "non_finite",
                                                                    "wrong_width")])
