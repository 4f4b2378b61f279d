"""Streaming queries (ST1-ST6) and the SQL function surface (F1, F2).

Each streaming query runs its job to completion with ``availableNow`` into a
fresh folder under the session's checkpoint folder and returns the sink read
back as a batch DataFrame, so it can be checked against the batch twin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions.text import NON_WS
from quire.functions.udtf import register_chunk_text
from quire.functions.vector import register_sql_functions
from quire.operators import dialogue, keyed, versions
from quire.plans.catalog import register
from quire.plans.q_tables import _U2_SQL, _status_log
from quire.plans.q_text import _EXT, _C23_SQL, chunk_oracle
from quire.session import checkpoint_path
from quire.sources.files import DOC_TEXT, PDF_TEXT, placeholder_sql
from quire.streaming import jobs
from quire.views import Fixture, duck_cte


def _run_dir(spark, name: str) -> str:
    return checkpoint_path(spark, "runs", f"{name}-{uuid.uuid4().hex}")


#: The order in which rows of a table land, in parts of about equal size.
LANDING = {"events": "ts", "documents": "doc_id", "conversations": "conv_id"}
PARTS = 4
#: Rows of one landed file, about: a part is written, and read again, by as
#: many tasks as it has files.
FILE_ROWS = {"documents": 20_000, "conversations": 100_000, "events": 2_000_000}


def _land(spark, sf_dir: str, table: str) -> tuple[str, int]:
    """The whole table landed as ``PARTS`` batches of files, one after the
    other in the table's order (cut at its quantiles), so that a stream over
    it has several micro-batches. Returns the folder and how many files a
    batch has at most."""
    t = Fixture(spark, sf_dir).table(table)
    at = F.col(LANDING[table])
    at = F.unix_micros(at.cast("timestamp")) if table == "events" else at
    got = t.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(at, [i / PARTS for i in range(1, PARTS)], 10_000).alias("q")).first()
    files = max(1, -(-got["n"] // (PARTS * FILE_ROWS[table])))
    part = sum((F.coalesce(at > F.lit(c), F.lit(False)).cast("int") for c in got["q"] or []), F.lit(0))
    landing = f"{_run_dir(spark, 'landing')}/{table}"
    for i in range(PARTS):  # a later part has later files
        t.filter(part == i).repartition(files).write.mode("append").parquet(landing)
    return landing, files


def _stream_view(spark, sf_dir: str, table: str):
    fx = Fixture(spark, sf_dir)
    schema = fx.table(table).schema
    landing, files = _land(spark, sf_dir, table)
    src = jobs.file_stream(spark, landing, schema, max_files=files)
    name = f"_stream_{table}_{uuid.uuid4().hex[:8]}"
    src.createOrReplaceTempView(name)
    return fx, name


# ---------------------------------------------------------------- ST1

_ST1_SQL = chunk_oracle(base=duck_cte("v_documents").replace("with ", "with recursive ", 1) + f"""
, f as (select id, text, regexp_extract(raw_path, '([^/]*)$', 1) as fname, {_EXT.format(p='raw_path')} as ext
        from v_documents),
ex as (
  select id, case when ext in ('.txt', '.md') then f.text
       when ext = '.pdf' then {placeholder_sql(PDF_TEXT, 'fname')}
       when ext in ('.doc', '.docx') then {placeholder_sql(DOC_TEXT, 'fname')}
     end as extracted
  from f join v_documents d using (id)
  where ext in ('.pdf', '.txt', '.docx', '.md') and octet_length(encode(d.text)) <= 30 * 1024 * 1024
), base as (select id as doc_id, coalesce(extracted, '') as t from ex)""") + f"""
select doc_id, chunk_index, content, cast(length(content) as bigint) as chunk_length,
       cast(len(regexp_extract_all(content, '{NON_WS}+')) as bigint) as token_count
from chunks
"""


@register("st1_stream_ingest", _ST1_SQL)
def st1_stream_ingest(spark, sf_dir):
    """ST1: landed documents stream through admission, extraction and
    chunking into the keyed chunk table (equals the batch pipeline)."""
    fx, name = _stream_view(spark, sf_dir, "documents")
    docs = fx.view_over("v_documents", documents=name)
    run = _run_dir(spark, "st1")
    out = jobs.ingest_batch(docs)
    jobs.run_available(out.writeStream.foreachBatch(
        jobs.keyed_append_sink(f"{run}/chunks", ["chunk_id"], ["chunk_index"]))
        .option("checkpointLocation", f"{run}/ck"))
    res = spark.read.parquet(f"{run}/chunks")
    return res.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "content",
                      F.col("chunk_length").cast("bigint").alias("chunk_length"),
                      F.col("token_count").cast("bigint").alias("token_count"))


# ---------------------------------------------------------------- ST2

_ST2_SQL = duck_cte("v_pages", "v_documents") + """
select d.raw_path as path, d.user_id, cast(p.page_id as varchar) as page_id,
       cast(length(p.content) as bigint) as text_length
from v_pages p join v_documents d on d.id = cast(p.doc_id as varchar)
"""


@register("st2_exactly_once_append", _ST2_SQL)
def st2_exactly_once_append(spark, sf_dir):
    """ST2: pages streamed twice (the second run replays everything from a
    fresh checkpoint) into a table pre-seeded with even pages: every key
    ends up stored exactly once."""
    fx = Fixture(spark, sf_dir)
    run = _run_dir(spark, "st2")
    target = f"{run}/pages"
    key = ["path", "user_id", "page_id"]

    def with_key(pages, docs):
        d = docs.select(F.col("id").cast("bigint").alias("doc_id"), F.col("raw_path").alias("path"), "user_id")
        return pages.join(d, "doc_id").select("path", "user_id", F.col("page_id").cast("string").alias("page_id"),
                                              F.col("content").alias("text"), F.lit(0).alias("ord"))

    seed = with_key(fx.pages(), fx.documents()).filter(F.col("page_id").cast("int") % 2 == 0)
    keyed.append(seed, target, key, ["ord"], buckets=8)
    for attempt in range(2):
        _, name = _stream_view(spark, sf_dir, "documents")
        pages = fx.view_over("v_pages_spark", documents=name)
        docs = fx.view_over("v_documents", documents=name)
        stream = with_key(pages, docs)
        jobs.run_available(stream.writeStream.foreachBatch(jobs.bucketed_append_sink(target, key, ["ord"]))
                           .option("checkpointLocation", f"{run}/ck{attempt}"))
    res = keyed.table(spark, target)
    return res.select("path", "user_id", "page_id", F.length("text").cast("bigint").alias("text_length"))


# ---------------------------------------------------------------- ST3

ST3_DELAY = "36500 days"
# with a delay beyond the table's whole time span a key passes exactly once,
# in whatever batches its rows arrive
_ST3_SQL = "select distinct user_id, event_type from events"


@register("st3_stream_dedupe", _ST3_SQL)
def st3_stream_dedupe(spark, sf_dir):
    """ST3: repeated (user, event type) arrivals dropped across micro-batches
    within a delay that covers the table (the tests use shorter ones)."""
    fx, name = _stream_view(spark, sf_dir, "events")
    ev = spark.table(name)
    run = _run_dir(spark, "st3")
    out = jobs.dedupe_stream(ev, ["user_id", "event_type"], ST3_DELAY)
    jobs.run_available(out.writeStream.format("parquet").option("path", f"{run}/out")
                       .option("checkpointLocation", f"{run}/ck").outputMode("append"))
    return spark.read.parquet(f"{run}/out").select("user_id", "event_type")


# ---------------------------------------------------------------- ST4

ST4_TIMEOUT_MIN = 300
ST4_DELAY_MIN = 10

_ST4_SQL = f"""
with c as (select event_id as req_id, user_id, ts from events where event_type = 'click'),
v as (select event_id as done_id, user_id, ts from events where event_type = 'view'),
m as (select c.req_id, arg_min(v.done_id, (v.ts, v.done_id)) as done_id
      from c join v on v.user_id = c.user_id and v.ts >= c.ts and v.ts <= c.ts + interval {ST4_TIMEOUT_MIN} minute
      group by c.req_id),
wm as (select least((select max(ts) from c), (select max(ts) from v)) - interval {ST4_DELAY_MIN} minute as w)
select c.req_id, m.done_id, case when m.done_id is not null then 'completed' else 'failed: AI parsing timeout' end as status
from c left join m on m.req_id = c.req_id
where m.done_id is not null or c.ts + interval {ST4_TIMEOUT_MIN} minute < (select w from wm)
"""


@register("st4_completion_timeout", _ST4_SQL)
def st4_completion_timeout(spark, sf_dir):
    """ST4: each click request with the earliest view of the same user within
    the timeout (300 minutes here), or a timeout failure once the watermark
    has passed its window (requests still open at the end are not emitted)."""
    fx, name = _stream_view(spark, sf_dir, "events")
    ev = spark.table(name)
    run = _run_dir(spark, "st4")
    pairs = jobs.completion_join(ev.filter(F.col("event_type") == "click"), ev.filter(F.col("event_type") == "view"),
                                 timeout=f"{ST4_TIMEOUT_MIN} minutes", delay=f"{ST4_DELAY_MIN} minutes",
                                 salts=4)
    jobs.run_available(pairs.writeStream.format("parquet").option("path", f"{run}/out")
                       .option("checkpointLocation", f"{run}/ck").outputMode("append"))
    return jobs.completion_status(spark.read.parquet(f"{run}/out"))


# ---------------------------------------------------------------- ST5

def _st5_oracle() -> str:
    return duck_cte("v_messages") + """
, lu as (select conv_id, max(created_at) as last_retrieval from v_messages where role = 'user' group by conv_id),
w as (select conv_id, id, role,
        least(count(*) over (partition by conv_id), 10)
          - row_number() over (partition by conv_id order by created_at desc, turn desc, id desc) + 1 as pos,
        row_number() over (partition by conv_id order by created_at desc, turn desc, id desc) as fe
      from v_messages)
select w.conv_id, w.id, cast(w.pos as bigint) as pos, w.role,
       strftime(lu.last_retrieval, '%Y-%m-%d %H:%M:%S') as last_retrieval
from w left join lu on lu.conv_id = w.conv_id where w.fe <= 10
"""


@register("st5_conversation_state", _st5_oracle())
def st5_conversation_state(spark, sf_dir):
    """ST5: the newest window of each conversation after all micro-batches;
    keyed conversation state (last 10 messages, last retrieval
    time) kept in RocksDB-backed state across micro-batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    fx, name = _stream_view(spark, sf_dir, "conversations")
    msgs = fx.view_over("v_messages", conversations=name)
    run = _run_dir(spark, "st5")
    out = jobs.conversation_state(msgs)
    jobs.run_available(out.writeStream.format("parquet").option("path", f"{run}/out")
                       .option("checkpointLocation", f"{run}/ck").outputMode("append"))
    # the newest window of each conversation: later updates replace earlier ones
    got = spark.read.parquet(f"{run}/out")
    newest = got.groupBy("conv_id").agg(F.max("seq").alias("seq"))
    return got.join(newest, ["conv_id", "seq"]).select(
        "conv_id", "id", "pos", "role", F.date_format("last_retrieval", "yyyy-MM-dd HH:mm:ss").alias("last_retrieval"))


# ---------------------------------------------------------------- ST6

@register("st6_status_stream", _U2_SQL)
def st6_status_stream(spark, sf_dir):
    """ST6: the status log folded live into a versioned status table (each
    batch rewrites only its buckets, in one atomic step); applied to the documents it equals the
    batch fold (U2)."""
    fx, name = _stream_view(spark, sf_dir, "events")
    log = _status_log(spark.table(name))
    run = _run_dir(spark, "st6")
    jobs.run_available(log.writeStream.foreachBatch(jobs.status_merge_sink(f"{run}/status"))
                       .option("checkpointLocation", f"{run}/ck"))
    latest = versions.read(spark, f"{run}/status")
    return dialogue.apply_status(fx.documents(), latest).select("id", "status", "error")


# ---------------------------------------------------------------- F1 / F2

@register("f1_chunk_text_udtf", _C23_SQL)
def f1_chunk_text_udtf(spark, sf_dir):
    """SQL table function ``chunk_text(text, size)`` used with LATERAL;
    equals the native C2/C3 chunker."""
    register_chunk_text(spark)
    docs = Fixture(spark, sf_dir).documents().select(F.col("id").alias("doc_id"), "text")
    name = f"_docs_{uuid.uuid4().hex[:8]}"
    docs.createOrReplaceTempView(name)
    return spark.sql(f"""
        select d.doc_id, cast(c.chunk_index as bigint) as chunk_index, c.content,
               cast(length(c.content) as bigint) as chunk_length, cast(c.token_count as bigint) as token_count
        from {name} d, lateral chunk_text(d.text, 1000) c""")


_F2_SQL = duck_cte("v_chunks", "v_queries") + """
, ranked as (
  select q.qid, c.id as chunk_id, list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) as distance,
         row_number() over (partition by q.qid
                            order by list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), c.id) as rank
  from v_queries q join v_chunks c on cast(q.qid as varchar) <> c.id
)
select qid, cast(rank as bigint) as rank, chunk_id, round(distance, 6) as distance_sql from ranked where rank <= 5
"""


@register("f2_sql_distance", _F2_SQL)
def f2_sql_distance(spark, sf_dir):
    """``l2_distance`` as a temporary SQL function, re-scoring the V1
    hits in SQL; equals the kernel's distances."""
    from quire.operators.search import knn
    register_sql_functions(spark)
    fx = Fixture(spark, sf_dir)
    hits = knn(fx.queries(), fx.chunks(), k=5, exclude_self=True)
    name = f"_hits_{uuid.uuid4().hex[:8]}"
    (hits.join(fx.queries().withColumnRenamed("embedding", "qv"), "qid")
     .join(fx.chunks().select("id", F.col("embedding").alias("cv")), "id")
     .createOrReplaceTempView(name))
    return spark.sql(f"""
        select qid, cast(rank as bigint) as rank, id as chunk_id,
               round(l2_distance(cast(qv as array<double>), cast(cv as array<double>)), 6) as distance_sql
        from {name}""")
