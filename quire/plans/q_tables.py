"""Relational, dialogue, prompt and embedding queries: T1-T9, A1-A3, W1-W5,
U1-U5, G1-G7, E1-E4."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions.text import NON_WS, WS_CLASS
from quire.operators import chunk_store, dialogue, embedding, lookup, parse, prompts, versions
from quire.operators.chunking import chunk_documents
from quire.plans.catalog import register
from quire.plans.chat import chat_prompts, retrieve_context
from quire.plans.q_text import chunk_oracle
from quire.session import checkpoint_path
from quire.views import Fixture, duck_cte

_STRIP = f"'^{WS_CLASS}+|{WS_CLASS}+$'"


# ---------------------------------------------------------------- T

_T1_SQL = duck_cte("v_conversations_core", "v_conv_docs", "v_documents") + """
select conv_id, doc_id from v_conv_docs
union
select c.id as conv_id, d.id as doc_id
from v_conversations_core c join v_documents d on d.user_id = c.user_id and d.status = 'processed'
where c.n_docs = 0
"""


@register("t1_search_scope", _T1_SQL)
def t1_search_scope(spark, sf_dir):
    """Own documents, else all processed documents of the user."""
    fx = Fixture(spark, sf_dir)
    return lookup.search_scope(fx.conversations(), fx.documents())


_T2_SQL = duck_cte("v_documents") + """
select user_id, id, cast(row_number() over (partition by user_id order by created_at desc, id) as bigint) as pos
from v_documents
"""


@register("t2_user_documents", _T2_SQL)
def t2_user_documents(spark, sf_dir):
    """Documents of each user, newest first."""
    d = lookup.user_documents(Fixture(spark, sf_dir).documents())
    return d.select("user_id", "id", F.col("pos").cast("bigint").alias("pos"))


_T3_SQL = duck_cte("v_conversations_core", "v_conv_docs", "v_documents") + """
select cd.conv_id, cd.doc_id as req_id, c.user_id as req_user, d.id is not null as found, d.filename
from v_conv_docs cd join v_conversations_core c on c.id = cd.conv_id
left join v_documents d on d.id = cd.doc_id and d.user_id = c.user_id
"""


@register("t3_owned_lookup", _T3_SQL)
def t3_owned_lookup(spark, sf_dir):
    """Documents named by conversations, found only when the user owns them."""
    fx = Fixture(spark, sf_dir)
    conv = fx.conversations().select(F.col("id").alias("conv_id"), "user_id")
    req = fx.conv_docs().join(conv, "conv_id").select(
        "conv_id", F.col("doc_id").alias("req_id"), F.col("user_id").alias("req_user"))
    docs = fx.documents().select("id", "user_id", "filename")
    return lookup.owned_lookup(req, docs).select("conv_id", "req_id", "req_user", "found", "filename")


def _doc_metadata(docs):
    """Documents with a metadata JSON (no metadata on every 11th)."""
    md = F.when(F.col("id").cast("bigint") % 11 == 0, F.lit(None)).otherwise(
        F.to_json(F.struct("filename", "status")))
    return docs.withColumn("metadata", md)


_T4_SQL = duck_cte("v_documents") + """
select id,
  case when cast(id as bigint) % 11 = 0 then 'Unknown' else filename end as filename,
  case when cast(id as bigint) % 11 = 0 then 'Unknown' else status end as status,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' as created_at
from v_documents
"""


@register("t4_document_view", _T4_SQL)
def t4_document_view(spark, sf_dir):
    """T4: filename/status from metadata JSON with 'Unknown' default, ISO time."""
    return lookup.document_view(_doc_metadata(Fixture(spark, sf_dir).documents()))


_T5_SQL = duck_cte("v_conversations_core") + """
select user_id, id, coalesce(title, 'New Conversation') as title, cast(n_docs as bigint) as document_count, pos
from (select *, cast(row_number() over (partition by user_id order by updated_at desc, id) as bigint) as pos
      from v_conversations_core) where pos <= 15
"""


@register("t5_user_conversations", _T5_SQL)
def t5_user_conversations(spark, sf_dir):
    """T5: the 15 most recent conversations per user with document counts."""
    c = lookup.user_conversations(Fixture(spark, sf_dir).conversations(), 15)
    return c.select("user_id", "id", F.coalesce("title", F.lit("New Conversation")).alias("title"),
                    F.col("document_count").cast("bigint").alias("document_count"),
                    F.col("pos").cast("bigint").alias("pos"))


_T6_SQL = duck_cte("v_conversations_core", "v_conv_docs", "v_documents") + """
select c.id as conv_id, cast(cd.pos as bigint) as pos, cd.doc_id, d.filename
from v_conversations_core c left join v_conv_docs cd on cd.conv_id = c.id
left join v_documents d on d.id = cd.doc_id
"""


@register("t6_conversation_documents", _T6_SQL)
def t6_conversation_documents(spark, sf_dir):
    """Each conversation with its documents in list order (names may be null)."""
    fx = Fixture(spark, sf_dir)
    t = lookup.conversation_documents(fx.conversations(), fx.documents())
    return t.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "doc_id", "filename")


_T7_SQL = duck_cte("v_messages") + """
select conv_id, id, role, cast(row_number() over (partition by conv_id order by created_at, turn, id) as bigint) as pos
from v_messages
"""


@register("t7_conversation_messages", _T7_SQL)
def t7_conversation_messages(spark, sf_dir):
    """Messages of each conversation in order."""
    m = lookup.conversation_messages(Fixture(spark, sf_dir).messages())
    return m.select("conv_id", "id", "role", F.col("pos").cast("bigint").alias("pos"))


_T8_SQL = duck_cte("v_documents") + """
select id, cast(case when cast(id as bigint) % 43 = 0 or cast(id as bigint) % 41 = 0
                       or cast(id as bigint) % 37 = 0 then 0
                  else ceil(n_chars / 2000.0) end as bigint) as total_chunks,
       not (cast(id as bigint) % 43 = 0 or cast(id as bigint) % 41 = 0 or cast(id as bigint) % 37 = 0) as completed
from v_documents
"""


@register("t8_processing_completion", _T8_SQL)
def t8_processing_completion(spark, sf_dir):
    """Parsed page rows per document path and user, completion flag."""
    fx = Fixture(spark, sf_dir)
    rows = parse.page_chunks(fx.parsed(), key_cols=("path", "user_id"))
    return lookup.processing_completion(fx.documents(), rows)


_T9_SQL = duck_cte("v_users") + """
select distinct cast(e.user_id as varchar) as user_id,
       cast(e.user_id as varchar) in (select id from v_users) as exists
from events e
"""


@register("t9_user_exists", _T9_SQL)
def t9_user_exists(spark, sf_dir):
    """Does each user id seen in events exist as a user?"""
    fx = Fixture(spark, sf_dir)
    req = fx.table("events").select(F.col("user_id").cast("string").alias("user_id")).distinct()
    return lookup.user_exists(req, fx.users()).select("user_id", "exists")


# ---------------------------------------------------------------- A

_A1_SQL = chunk_oracle() + """
select b.doc_id, cast(count(c.content) as bigint) as chunks_created,
  cast(coalesce(sum(len(regexp_extract_all(c.content, '""" + NON_WS + """+'))), 0) as bigint) as total_tokens,
  cast(coalesce(sum(length(c.content)), 0) as bigint) as total_length,
  case when count(c.content) > 0 then 'processed' else 'failed' end as status,
  case when count(c.content) = 0 then 'Failed to process document content' end as error
from base b left join chunks c on c.doc_id = b.doc_id group by b.doc_id
"""


@register("a1_processing_result", _A1_SQL)
def a1_processing_result(spark, sf_dir):
    """A1: per-document chunk count, tokens, length and final status."""
    d = Fixture(spark, sf_dir).documents()
    return lookup.processing_result(d, chunk_documents(d))


_A2_SQL = duck_cte("v_documents", "v_conversations_core", "v_messages") + """
, d as (select user_id,
          count(*) filter (where status = 'uploaded') as docs_uploaded,
          count(*) filter (where status = 'processing') as docs_processing,
          count(*) filter (where status = 'processed') as docs_processed,
          count(*) filter (where status = 'failed') as docs_failed
        from v_documents group by user_id),
c as (select user_id, count(*) as conversations from v_conversations_core group by user_id),
m as (select c.user_id,
          count(*) filter (where m.role = 'user') as msgs_user,
          count(*) filter (where m.role = 'assistant') as msgs_assistant,
          count(*) filter (where m.role = 'system') as msgs_system
      from v_messages m join v_conversations_core c on c.id = m.conv_id group by c.user_id),
u as (select user_id from d union select user_id from c)
select u.user_id,
  cast(coalesce(docs_uploaded, 0) as bigint) as docs_uploaded, cast(coalesce(docs_processing, 0) as bigint) as docs_processing,
  cast(coalesce(docs_processed, 0) as bigint) as docs_processed, cast(coalesce(docs_failed, 0) as bigint) as docs_failed,
  cast(coalesce(conversations, 0) as bigint) as conversations,
  cast(coalesce(msgs_user, 0) as bigint) as msgs_user, cast(coalesce(msgs_assistant, 0) as bigint) as msgs_assistant,
  cast(coalesce(msgs_system, 0) as bigint) as msgs_system
from u left join d using (user_id) left join c using (user_id) left join m using (user_id)
"""


@register("a2_user_counts", _A2_SQL)
def a2_user_counts(spark, sf_dir):
    """A2: per user documents by status, conversations, messages by role."""
    fx = Fixture(spark, sf_dir)
    return lookup.user_counts(fx.documents(), fx.conversations(), fx.messages())


# ---------------------------------------------------------------- W

_W1_SQL = duck_cte("v_messages") + """
select conv_id, id, cast(pos as bigint) as pos from (
  select conv_id, id,
    least(count(*) over (partition by conv_id), 10) - row_number() over (partition by conv_id order by created_at desc, turn desc, id desc) + 1 as pos,
    row_number() over (partition by conv_id order by created_at desc, turn desc, id desc) as from_end
  from v_messages) where from_end <= 10
"""


@register("w1_last_messages", _W1_SQL)
def w1_last_messages(spark, sf_dir):
    """The last 10 messages of every conversation, in order."""
    m = dialogue.last_messages(Fixture(spark, sf_dir).messages(), 10)
    return m.select("conv_id", "id", F.col("pos").cast("bigint").alias("pos"))


_W2_SQL = duck_cte("v_messages") + """
select conv_id, arg_max(turn, turn) as turn, arg_max(text, turn) as text
from v_messages where role = 'user' group by conv_id
"""


@register("w2_last_user_message", _W2_SQL)
def w2_last_user_message(spark, sf_dir):
    """The newest user message of every conversation."""
    return dialogue.last_user_message(Fixture(spark, sf_dir).messages()).select("conv_id", "turn", "text")


_W3_SQL = duck_cte("v_messages") + """
select conv_id, user_message_id, question,
       case when next_role = 'assistant' then next_id end as answer_id,
       case when next_role = 'assistant' then next_text end as answer
from (select conv_id, id as user_message_id, text as question, role,
        lead(role) over w as next_role, lead(text) over w as next_text, lead(id) over w as next_id
      from v_messages window w as (partition by conv_id order by created_at, turn, id))
where role = 'user'
"""


@register("w3_exchanges", _W3_SQL)
def w3_exchanges(spark, sf_dir):
    """Each user message paired with the assistant reply that follows it."""
    return dialogue.exchanges(Fixture(spark, sf_dir).messages()).select(
        "conv_id", "user_message_id", "question", "answer_id", "answer")


_W4_SQL = duck_cte("v_messages") + """
select id, cast(count(*) over (partition by conv_id order by created_at, turn, id
                               rows between unbounded preceding and current row) as bigint) as messages_so_far,
       count(*) over (partition by conv_id order by created_at, turn, id
                      rows between unbounded preceding and current row) <= 2 as is_first_exchange
from v_messages
"""


@register("w4_first_exchange", _W4_SQL)
def w4_first_exchange(spark, sf_dir):
    """Running message count and the first-exchange flag."""
    m = dialogue.first_exchange_flag(Fixture(spark, sf_dir).messages())
    return m.select("id", F.col("messages_so_far").cast("bigint").alias("messages_so_far"), "is_first_exchange")


# ---------------------------------------------------------------- E (DuckDB text embedder)

def _sparse_sql(name: str, src: str, id_col: str, text_col: str) -> str:
    """DuckDB twin of the default embedder: ``name(id, b, v)`` signed counts."""
    return f"""
{name}_tok as (select {id_col} as id, unnest(regexp_extract_all({text_col}, '{NON_WS}+')) as t from {src}),
{name} as (
  select id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 as b,
         sum(case when ('0x' || substr(md5(t), 9, 2))::INT < 128 then 1 else -1 end) as v
  from {name}_tok group by all having sum(case when ('0x' || substr(md5(t), 9, 2))::INT < 128 then 1 else -1 end) <> 0
)"""


_E1_SQL = duck_cte("v_documents") + ", " + _sparse_sql("sp", "v_documents", "id", "text") + """
select id as doc_id, cast(b as integer) as bucket,
       round(v / sqrt(sum(v * v) over (partition by id)), 6) as value
from sp
"""


@register("e1_embed_sparse", _E1_SQL)
def e1_embed_sparse(spark, sf_dir):
    """Default embedder over every document (sparse, normalised)."""
    d = Fixture(spark, sf_dir).documents().select(F.col("id").alias("doc_id"), "text")
    s = embedding.hash_embed_sparse(d, "doc_id", "text")
    return s.select("doc_id", "bucket", F.round("value", 6).alias("value"))


@register("e2_embed_batches", _E1_SQL)
def e2_embed_batches(spark, sf_dir):
    """The same embedder as a Python callable in batches of 10 via
    mapInPandas; must equal E1."""
    d = Fixture(spark, sf_dir).documents().select(F.col("id").alias("doc_id"), "text")
    e = embedding.embed_batches(d, ["doc_id"], "text", embedding.python_hash_embedder(), batch_size=10)
    s = e.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).filter(F.col("value") != 0)
    return s.select("doc_id", F.col("bucket").cast("int").alias("bucket"), F.round("value", 6).alias("value"))


_E3_SQL = duck_cte("v_messages") + ", " + _sparse_sql("sp", "v_messages", "id", "text") + f"""
select m.id, regexp_replace(coalesce(m.text, ''), {_STRIP}, '', 'g') <> '' as success,
  case when regexp_replace(coalesce(m.text, ''), {_STRIP}, '', 'g') <> '' then 'ok' else 'Empty query text' end as message,
  case when regexp_replace(coalesce(m.text, ''), {_STRIP}, '', 'g') <> ''
       then cast((select count(*) from sp where sp.id = m.id) as bigint) end as nonzero
from v_messages m where m.role = 'user'
"""


@register("e3_query_embeddings", _E3_SQL)
def e3_query_embeddings(spark, sf_dir):
    """Embed every user message as a query; empty ones become failure rows."""
    m = Fixture(spark, sf_dir).messages().filter(F.col("role") == "user").select("id", "text")
    e = embedding.embed_queries(m, "id", "text")
    nz = F.when(F.col("success"), F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint"))
    return e.select("id", "success", "message", nz.alias("nonzero"))


_E4_SQL = duck_cte("v_documents") + ", " + _sparse_sql("sp", "v_documents", "id", "text") + """
select id as doc_id, sha256(d.text) as text_hash, cast(b as integer) as bucket,
       round(v / sqrt(sum(v * v) over (partition by id)), 6) as value
from sp join v_documents d using (id)
"""


@register("e4_embed_distinct", _E4_SQL)
def e4_embed_distinct(spark, sf_dir):
    """Embed each distinct text once, join back to every document."""
    d = Fixture(spark, sf_dir).documents().select(F.col("id").alias("doc_id"), "text")
    s = embedding.embed_distinct(d, "doc_id", "text")
    return s.select("doc_id", "text_hash", "bucket", F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- chat plan (V4 + W5 + G1 + A3)

def _chat_oracle_cte(k: int = 3) -> str:
    views = duck_cte("v_messages", "v_conversations_core", "v_conv_docs", "v_documents").replace("with ", "with recursive ", 1)
    return chunk_oracle(base=views + ", base as (select id as doc_id, coalesce(text, '') as t from v_documents)") + f"""
, v_chunks as (select sha256(doc_id || ':' || cast(chunk_index as varchar)) as id, doc_id, content from chunks),
q as (select conv_id, arg_max(text, turn) as text from v_messages where role = 'user' group by conv_id),
{_sparse_sql("qsp", "q", "conv_id", "text")},
{_sparse_sql("csp", "v_chunks", "id", "content")},
qn as (select id, sum(v * v) as n2 from qsp group by id),
cn as (select id, sum(v * v) as n2 from csp group by id),
scope as (
  select conv_id, doc_id from v_conv_docs
  union
  select c.id as conv_id, d.id as doc_id
  from v_conversations_core c join v_documents d on d.user_id = c.user_id and d.status = 'processed'
  where c.n_docs = 0
),
dots as (
  select s.conv_id, c.id as chunk_id, sum(qs.v * cs.v) as dot
  from scope s join v_chunks c on c.doc_id = s.doc_id join qsp qs on qs.id = s.conv_id
  join csp cs on cs.id = c.id and cs.b = qs.b group by all
),
pairs as (
  select s.conv_id, c.id as chunk_id, c.content,
         1 - cast(coalesce(d.dot, 0) as double) / (sqrt(cast(qn.n2 as double)) * sqrt(cast(cn.n2 as double))) as distance
  from scope s join v_chunks c on c.doc_id = s.doc_id
  join qn on qn.id = s.conv_id join cn on cn.id = c.id
  left join dots d on d.conv_id = s.conv_id and d.chunk_id = c.id
),
ctx as (
  select * from (select *, row_number() over (partition by conv_id order by distance, chunk_id) as position from pairs)
  where position <= {k}
),
last5 as (
  select * from (select *, row_number() over (partition by conv_id order by created_at desc, turn desc, id desc) as from_end
                 from v_messages) where from_end <= 5
)"""


_W5_SQL = _chat_oracle_cte() + """
select conv_id, cast(position as bigint) as position, chunk_id, round(distance, 6) as distance from ctx
"""


def _stored_chunks(spark, fx):
    """The documents' chunks (C2/C3) from a chunk store."""
    base = checkpoint_path(spark, "runs", f"chunks-{uuid.uuid4().hex}")
    chunk_store.refresh(fx.documents(), base)
    return versions.read(spark, base)


@register("w5_context_rank", _W5_SQL)
def w5_context_rank(spark, sf_dir):
    """V4 + W5: top 3 chunks (cosine, scoped) for each conversation's last question."""
    fx = Fixture(spark, sf_dir)
    ctx = retrieve_context(fx.messages(), fx.conversations(), fx.documents(), _stored_chunks(spark, fx))
    return ctx.select("conv_id", F.col("position").cast("bigint").alias("position"), "chunk_id",
                      F.round("distance", 6).alias("distance"))


_G1_SQL = _chat_oracle_cte() + """
, ctxs as (select conv_id, count(*) as n,
       string_agg(chr(10) || 'Document ' || cast(position as varchar) || ': ' || substring(content, 1, 500), '' order by position) as s
     from ctx group by conv_id),
msgs as (select conv_id, string_agg(chr(10) || upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text, ''
                                    order by from_end desc) as s from last5 group by conv_id),
p as (
  select c.id as conv_id,
    'You are a helpful document intelligence assistant. You can answer questions about uploaded documents and provide general assistance.'
    || coalesce(chr(10) || chr(10) || 'Relevant document context:' || x.s, '')
    || chr(10) || chr(10) || 'Conversation:' || coalesce(m.s, '') || chr(10) || chr(10) || 'Assistant:' as prompt,
    cast(coalesce(x.n, 0) as bigint) as context_docs_count
  from v_conversations_core c left join ctxs x on x.conv_id = c.id left join msgs m on m.conv_id = c.id
)
select conv_id, prompt, context_docs_count, cast(length(prompt) as bigint) as prompt_length from p
"""


@register("g1_chat_prompts", _G1_SQL)
def g1_chat_prompts(spark, sf_dir):
    """G1 + A3: the whole chat-turn plan to one prompt per conversation."""
    fx = Fixture(spark, sf_dir)
    return chat_prompts(fx.messages(), fx.conversations(), fx.documents(), _stored_chunks(spark, fx))


_G2_SQL = _chat_oracle_cte() + """
, ctxs as (select conv_id,
       string_agg(chr(10) || chr(10) || 'Context ' || cast(position as varchar) || ':' || chr(10) ||
                  case when length(content) > 500 then substring(content, 1, 500) || '...' else content end, ''
                  order by position) as s
     from ctx group by conv_id),
last6 as (select * from (select *, row_number() over (partition by conv_id order by created_at desc, turn desc, id desc) as fe
                         from v_messages) where fe <= 6),
msgs as (select conv_id, string_agg(chr(10) || case when role = 'user' then 'Human' else 'Assistant' end || ': ' || text, ''
                                    order by fe desc) as s from last6 group by conv_id),
nm as (select conv_id, count(*) as n from v_messages group by conv_id)
select q.conv_id,
  'You are a helpful AI assistant that specializes in document analysis and intelligent conversation. Use the provided context from documents to answer questions accurately and comprehensively.'
  || coalesce(chr(10) || chr(10) || 'Relevant Document Context:' || x.s, '')
  || case when nm.n > 1 then chr(10) || chr(10) || 'Recent Conversation:' || coalesce(m.s, '') else '' end
  || chr(10) || chr(10) || 'Human: ' || q.text || chr(10) || chr(10) || 'Assistant:' as prompt
from q join nm on nm.conv_id = q.conv_id left join ctxs x on x.conv_id = q.conv_id left join msgs m on m.conv_id = q.conv_id
"""


@register("g2_agent_prompts", _G2_SQL)
def g2_agent_prompts(spark, sf_dir):
    """The second prompt layout for every conversation with a question."""
    fx = Fixture(spark, sf_dir)
    msgs = fx.messages()
    ctx = retrieve_context(msgs, fx.conversations(), fx.documents(), _stored_chunks(spark, fx))
    q = dialogue.last_user_message(msgs).select("conv_id", "text")
    counts = msgs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return prompts.agent_prompt(q, dialogue.last_messages(msgs, 6), counts, ctx)


_G3_SQL = duck_cte("v_messages") + """
, last5 as (select * from (select *, row_number() over (partition by conv_id order by created_at desc, turn desc, id desc) as fe
                           from v_messages) where fe <= 5)
select conv_id,
  'Please analyze this conversation and provide:' || chr(10) || '1. A brief summary (2-3 sentences)' || chr(10) ||
  '2. A short, descriptive title (max 50 characters)' || chr(10) || chr(10) || 'Conversation:' || chr(10) ||
  string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || substring(text, 1, 200) || chr(10), '' order by fe desc) ||
  chr(10) || 'Please format your response as:' || chr(10) || 'Summary: [summary]' || chr(10) || 'Title: [title]' as prompt
from last5 group by conv_id
"""


@register("g3_summary_prompts", _G3_SQL)
def g3_summary_prompts(spark, sf_dir):
    """Summarisation prompt per conversation."""
    return prompts.summary_prompt(dialogue.last_messages(Fixture(spark, sf_dir).messages(), 5))


def _answers(msgs):
    """Model answers per conversation: ``Summary: <first message>`` and, except
    on every 6th conversation, ``Title: <last message>`` lines."""
    a = msgs.groupBy("conv_id").agg(F.min_by("text", "turn").alias("_f"), F.max_by("text", "turn").alias("_l"))
    return a.select("conv_id", F.when(F.col("conv_id").cast("bigint") % 6 == 0,
                                      F.concat(F.lit("Summary: "), F.col("_f")))
                    .otherwise(F.concat(F.lit("Summary: "), F.col("_f"), F.lit("\nTitle: "), F.col("_l")))
                    .alias("answer"))


_ANSWERS_CTE = """
, ans as (
  select conv_id, case when cast(conv_id as bigint) % 6 = 0 then 'Summary: ' || arg_min(text, turn)
                       else 'Summary: ' || arg_min(text, turn) || chr(10) || 'Title: ' || arg_max(text, turn) end as answer
  from v_messages group by conv_id
), lines as (
  select conv_id, unnest(string_split(answer, chr(10))) as line, generate_subscripts(string_split(answer, chr(10)), 1) as i from ans
), parsed as (
  select a.conv_id,
    coalesce((select regexp_replace(replace(l.line, 'Summary:', ''), """ + _STRIP + """, '', 'g') from lines l
              where l.conv_id = a.conv_id and starts_with(l.line, 'Summary:') order by l.i desc limit 1), '') as summary,
    (select regexp_replace(replace(l.line, 'Title:', ''), """ + _STRIP + """, '', 'g') from lines l
     where l.conv_id = a.conv_id and starts_with(l.line, 'Title:') order by l.i desc limit 1) as t
  from ans a
)"""

_G4_SQL = duck_cte("v_messages") + _ANSWERS_CTE + """
select conv_id, summary, case when t is null or t = '' then 'New Conversation' else t end as title from parsed
"""


@register("g4_parse_answers", _G4_SQL)
def g4_parse_answers(spark, sf_dir):
    """Summary and title parsed from model answers."""
    a = _answers(Fixture(spark, sf_dir).messages())
    s, t = prompts.parse_answer(F.col("answer"))
    return a.select("conv_id", s.alias("summary"), t.alias("title"))


_G5_SQL = duck_cte("v_conversations_core", "v_conv_docs", "v_documents") + """
, names as (
  select cd.conv_id, list(d.filename order by cd.pos) as names
  from v_conv_docs cd join v_documents d on d.id = cd.doc_id group by cd.conv_id
)
select c.id,
  case when c.title is not null and c.title <> '' then c.title
       when c.n_docs = 0 then 'New Conversation'
       when n.names is null then 'Document Chat'
       else 'Chat with ' || array_to_string(n.names[1:2], ', ') ||
            case when len(n.names) > 2 then ' and ' || cast(len(n.names) - 2 as varchar) || ' more' else '' end
  end as new_title
from v_conversations_core c left join names n on n.conv_id = c.id
"""


@register("g5_title_from_documents", _G5_SQL)
def g5_title_from_documents(spark, sf_dir):
    """Conversation title from its documents when none is given."""
    fx = Fixture(spark, sf_dir)
    return prompts.title_from_documents(fx.conversations(), fx.documents()).select("id", "new_title")


_G6_SQL = duck_cte("v_conversations_core") + """
select id, case when length(coalesce(title, 'New Conversation')) > 22
                then substring(coalesce(title, 'New Conversation'), 1, 22) || '...'
                else coalesce(title, 'New Conversation') end as display_title
from v_conversations_core
"""


@register("g6_display_title", _G6_SQL)
def g6_display_title(spark, sf_dir):
    """Display title cut at 22 characters with '...'."""
    c = Fixture(spark, sf_dir).conversations()
    return c.select("id", prompts.display_title(F.coalesce("title", F.lit("New Conversation"))).alias("display_title"))


_G7_SQL = duck_cte("v_messages", "v_conversations_core") + """
select m.id,
  case when c.n_docs > 0 then 'context'
       when contains(lower(m.text), 'hello') or contains(lower(m.text), 'hi') then 'greeting'
       when contains(lower(m.text), 'document') then 'document'
       when contains(lower(m.text), 'help') then 'help' else 'other' end as label
from v_messages m join v_conversations_core c on c.id = m.conv_id where m.role = 'user'
"""


@register("g7_fallback_label", _G7_SQL)
def g7_fallback_label(spark, sf_dir):
    """Rule label of every user message (context = conversation has documents)."""
    fx = Fixture(spark, sf_dir)
    c = fx.conversations().select(F.col("id").alias("conv_id"),
                                  (F.size(F.coalesce("doc_ids", F.array().cast("array<string>"))) > 0).alias("ctx"))
    m = fx.messages().filter(F.col("role") == "user").join(c, "conv_id")
    return m.select("id", prompts.fallback_label(F.col("text"), F.col("ctx")).alias("label"))


# ---------------------------------------------------------------- U

_U1_SQL = duck_cte("v_conversations_core", "v_conv_docs") + """
, adds as (
  select id as conv_id, 10 as pos, cast((cast(id as bigint) * 3) % (select count(*) from documents) as varchar) as doc_id from v_conversations_core
  union all
  select conv_id, 11 as pos, doc_id from v_conv_docs where pos = 0
), allr as (select conv_id, pos, doc_id from v_conv_docs union all select * from adds),
firsts as (select conv_id, doc_id, min(pos) as pos from allr group by all)
select conv_id as id, string_agg(doc_id, ',' order by pos) as doc_ids from firsts group by conv_id
"""


@register("u1_add_documents", _U1_SQL)
def u1_add_documents(spark, sf_dir):
    """Add documents to every conversation without duplicates, order kept."""
    fx = Fixture(spark, sf_dir)
    conv = fx.conversations()
    n_docs = fx.table("documents").count()
    adds = (conv.select(F.col("id").alias("conv_id"), F.lit(0).alias("seq"),
                        ((F.col("id").cast("bigint") * 3) % n_docs).cast("string").alias("doc_id"))
            .unionByName(fx.conv_docs().filter(F.col("pos") == 0)
                         .select("conv_id", F.lit(1).alias("seq"), "doc_id")))
    out = dialogue.add_documents(conv, adds)
    return out.select("id", F.array_join("doc_ids", ",").alias("doc_ids"))


def _status_log(events):
    """Status log from events: document = user_id; status by event type."""
    st = (F.when(F.col("event_type") == "signup", "uploaded")
          .when(F.col("event_type").isin("click", "view"), "processing")
          .when(F.col("event_type") == "purchase", "processed")
          .when(F.col("event_type") == "error", "failed"))
    return events.select(F.col("user_id").cast("string").alias("doc_id"), st.alias("status"),
                         F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
                         F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


_U2_SQL = duck_cte("v_documents") + """
, log as (
  select cast(user_id as varchar) as doc_id,
    case event_type when 'signup' then 'uploaded' when 'click' then 'processing' when 'view' then 'processing'
                    when 'purchase' then 'processed' when 'error' then 'failed' end as status,
    case when event_type = 'error' then props end as error, ts, event_id
  from events
), latest as (
  select doc_id, arg_max(struct_pack(st := status, err := error), (ts, event_id)) as b from log group by doc_id
)
select d.id, coalesce(l.b.st, d.status) as status, l.b.err as error
from v_documents d left join latest l on l.doc_id = d.id
"""


@register("u2_apply_status_log", _U2_SQL)
def u2_apply_status_log(spark, sf_dir):
    """Fold the status log to the latest entry per document and apply it."""
    fx = Fixture(spark, sf_dir)
    latest = dialogue.latest_status(_status_log(fx.table("events")))
    return dialogue.apply_status(fx.documents(), latest).select("id", "status", "error")


_U3_SQL = duck_cte("v_messages", "v_conversations_core") + _ANSWERS_CTE + """
select c.id, case when p.t is not null and p.t <> '' and p.t <> 'New Conversation' then p.t else c.title end as title
from v_conversations_core c left join parsed p on p.conv_id = c.id
"""


@register("u3_update_titles", _U3_SQL)
def u3_update_titles(spark, sf_dir):
    """Titles from parsed answers, ignoring empty and 'New Conversation'."""
    fx = Fixture(spark, sf_dir)
    _, t = prompts.parse_answer(F.col("answer"))
    titles = _answers(fx.messages()).select(F.col("conv_id").alias("id"), t.alias("new_title"))
    return dialogue.update_titles(fx.conversations(), titles).select("id", "title")


_U4_SQL = duck_cte("v_messages", "v_conversations_core") + """
select m.conv_id, cast(count(*) as bigint) as messages
from v_messages m where m.conv_id not in (select id from v_conversations_core where title is null)
group by m.conv_id
"""


@register("u4_delete_conversations", _U4_SQL)
def u4_delete_conversations(spark, sf_dir):
    """U4: delete untitled conversations with their messages; count what is left."""
    fx = Fixture(spark, sf_dir)
    conv = fx.conversations()
    req = conv.filter(F.col("title").isNull()).select("id")
    _, msgs = dialogue.delete_conversations(conv, fx.messages(), req)
    return msgs.groupBy("conv_id").agg(F.count(F.lit(1)).cast("bigint").alias("messages"))


_U5_SQL = duck_cte("v_conversations_core") + """
select id, case when updated_at < timestamp '2024-01-03 00:00:00' then 'archived' else 'active' end as status
from v_conversations_core
"""


@register("u5_archive", _U5_SQL)
def u5_archive(spark, sf_dir):
    """Archive conversations not updated since the cutoff, as one atomic
    change of the stored table."""
    base = checkpoint_path(spark, "runs", f"conversations-{uuid.uuid4().hex}")
    versions.overwrite(Fixture(spark, sf_dir).conversations(), base, ["id"])
    dialogue.archive_table(spark, base, "2024-01-03 00:00:00")
    c = versions.read(spark, base)
    return c.select("id", "status")
