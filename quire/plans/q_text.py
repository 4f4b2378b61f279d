"""Text and file queries: S1-S4, P1-P5/C1, C2-C6, G8, G9."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import NON_WS, WS_CLASS
from quire.operators import chunking, parse
from quire.plans.catalog import register
from quire.sources import files
from quire.sources.files import DOC_TEXT, PDF_TEXT, placeholder_sql
from quire.views import BASE_TABLES, Fixture, duck_cte, more_views

ORACLE_DIR = "/root/testdata/sf0.01"
_STRIP = f"'^{WS_CLASS}+|{WS_CLASS}+$'"
_EXT = "lower(regexp_extract(regexp_extract({p}, '([^/]*)$', 1), '^.+?(\\.[^.]*)$', 1))"

# ---------------------------------------------------------------- chunking


def _greedy_sql(parts_expr: str, joiner: str, suffix: str, size: int, tag: str) -> str:
    """DuckDB recursive CTE for the greedy packer over the list ``parts_expr``
    of table ``base(doc_id, t)``; yields ``{tag}_chunks(doc_id, ord, chunk)``."""
    return f"""
{tag}_parts as (
  select doc_id, list_filter(list_transform({parts_expr}, lambda p: regexp_replace(p, {_STRIP}, '', 'g')),
                             lambda p: p <> '') as parts from base
), {tag}_el as (
  select doc_id, unnest(parts) as x, generate_subscripts(parts, 1) as i from {tag}_parts
), {tag}_rec(doc_id, i, cur, emitted) as (
  select doc_id, 0, '', cast(null as varchar) from {tag}_parts
  union all
  select r.doc_id, r.i + 1,
         case when length(r.cur) + length(e.x) > {size} and r.cur <> '' then e.x
              when r.cur <> '' then r.cur || {joiner} || e.x else e.x end,
         case when length(r.cur) + length(e.x) > {size} and r.cur <> '' then r.cur || '{suffix}' end
  from {tag}_rec r join {tag}_el e on e.doc_id = r.doc_id and e.i = r.i + 1
), {tag}_chunks as (
  select doc_id, i as ord, emitted as chunk from {tag}_rec where emitted is not null
  union all
  select doc_id, i + 1 as ord, cur || '{suffix}' as chunk from {tag}_rec
  where cur <> '' qualify row_number() over (partition by doc_id order by i desc) = 1
)"""


def chunk_oracle(size: int = 1000, base: str | None = None) -> str:
    """DuckDB chunker over ``base(doc_id, t)``; defines ``chunks(doc_id,
    chunk_index, content)``. ``base`` is a ``with recursive ...`` prefix
    ending in the ``base`` view (default: every document's text)."""
    if base is None:
        base = duck_cte("v_documents").replace("with ", "with recursive ", 1) + \
            "\n, base as (select id as doc_id, coalesce(text, '') as t from v_documents)"
    para = _greedy_sql("string_split(t, chr(10) || chr(10))", "chr(10) || chr(10)", "", size, "pa")
    sent = _greedy_sql("string_split(replace(t, chr(10), ' '), '. ')", "' '", ".", size, "se")
    return base + f""",
{para},
{sent},
pstat as (
  select b.doc_id, count(c.chunk) as n, max(length(c.chunk)) as mx
  from base b left join pa_chunks c on c.doc_id = b.doc_id group by b.doc_id
), picked as (
  select c.doc_id, c.ord, c.chunk from pa_chunks c join pstat s on s.doc_id = c.doc_id
  where s.n > 0 and s.mx <= {2 * size}
  union all
  select c.doc_id, c.ord, c.chunk from se_chunks c join pstat s on s.doc_id = c.doc_id
  where s.n = 0 or s.mx > {2 * size}
), chunks as (
  select doc_id, cast(row_number() over (partition by doc_id order by ord) - 1 as bigint) as chunk_index,
         chunk as content from picked
)"""


_C23_SQL = chunk_oracle() + f"""
select doc_id, chunk_index, content, cast(length(content) as bigint) as chunk_length,
       cast(len(regexp_extract_all(content, '{NON_WS}+')) as bigint) as token_count
from chunks
"""


def _chunks(spark, sf_dir):
    return chunking.chunk_documents(Fixture(spark, sf_dir).documents())


@register("c23_simple_chunks", _C23_SQL)
def c23_simple_chunks(spark, sf_dir):
    """C2+C3+C5: paragraph packing with sentence fallback over every document."""
    return _chunks(spark, sf_dir).select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "content",
        F.col("chunk_length").cast("bigint").alias("chunk_length"),
        F.col("token_count").cast("bigint").alias("token_count"))


_C4_SQL = duck_cte("v_documents") + """
, w as (
  select id as doc_id, text, unnest(range(0, case when length(text) = 0 then 0
           when length(text) <= 512 then 1
           else cast(ceil((length(text) - 512) / 462.0) as bigint) + 1 end)) as k
  from v_documents
)
select doc_id, cast(k as bigint) as chunk_index, substring(text, k * 462 + 1, 512) as content,
       cast(length(substring(text, k * 462 + 1, 512)) as bigint) as chunk_length
from w
"""


@register("c4_window_chunks", _C4_SQL)
def c4_window_chunks(spark, sf_dir):
    """C4: overlapping fixed windows (512, overlap 50) over every document."""
    d = Fixture(spark, sf_dir).documents().select(F.col("id").alias("doc_id"), "text")
    out = d.select("doc_id", F.posexplode(chunking.window_chunks(F.col("text"), 512, 50))
                   .alias("chunk_index", "content"))
    return out.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "content",
                      F.length("content").cast("bigint").alias("chunk_length"))


_C6_SQL = chunk_oracle() + more_views("v_conv_docs") + """
select c.doc_id, c.chunk_index, cast(length(c.content) as bigint) as chunk_length,
       cast(count(*) over (partition by c.doc_id) as bigint) as n_chunks
from chunks c where c.doc_id in (select doc_id from v_conv_docs)
"""


@register("c6_chunks_of_documents", _C6_SQL)
def c6_chunks_of_documents(spark, sf_dir):
    """Chunks of the documents referenced by conversations, in order."""
    fx = Fixture(spark, sf_dir)
    d = chunking.chunks_of(fx.documents().select(F.col("id").alias("doc_id"), "text"), fx.conv_docs())
    d = chunking.with_simple_chunks(d, "text", "_chunks").withColumn("n_chunks", F.size("_chunks").cast("bigint"))
    ch = chunking.explode_chunks(d, F.col("_chunks"), ["doc_id", "n_chunks"])
    return ch.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                     F.col("chunk_length").cast("bigint").alias("chunk_length"), "n_chunks")


# ---------------------------------------------------------------- files

_S1_SQL = f"""
select regexp_extract(filename, '([^/]+)$', 1) as name, cast(size as bigint) as length,
       substr(sha256(content), 1, 16) as content_hash
from read_blob('{ORACLE_DIR}/*.parquet')
"""


@register("s1_scan_files", _S1_SQL)
def s1_scan_files(spark, sf_dir):
    """S1 (+G8 hash): every file of the data folder with its size and content hash."""
    f = files.hashed_files(files.scan_files(spark, sf_dir, glob="*.parquet"))
    return f.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "content_hash")


_REQ_TABLES = ", ".join(f"('{t}.parquet')" for t in BASE_TABLES)
_S2_SQL = duck_cte("v_documents") + f"""
, inv as (select regexp_extract(filename, '([^/]+)$', 1) as name from read_blob('{ORACLE_DIR}/*.parquet')),
req as (select distinct source || '.parquet' as name from v_documents
        union select * from (values {_REQ_TABLES}) t(name))
select r.name, exists (select 1 from inv i where i.name = r.name) as exists from req r
"""


@register("s2_file_inventory", _S2_SQL)
def s2_file_inventory(spark, sf_dir):
    """Which requested file names exist (listing reads no file bytes)."""
    fx = Fixture(spark, sf_dir)
    inv = files.file_inventory(files.scan_files(spark, sf_dir, glob="*.parquet").select(
        "path", "length", "modificationTime"))
    req = (fx.documents().select(F.concat("source", F.lit(".parquet")).alias("name"))
           .union(spark.createDataFrame([(f"{t}.parquet",) for t in BASE_TABLES], "name string"))
           .distinct())
    return files.files_exist(req, inv.select("name"), key="name").select("name", "exists")


_S3_SQL = duck_cte("v_documents") + f"""
select id, {_EXT.format(p='raw_path')} as extension,
       case when {_EXT.format(p='raw_path')} not in ('.pdf', '.txt', '.docx', '.md')
            then 'extension not allowed: ' || {_EXT.format(p='raw_path')}
            when octet_length(encode(text)) > 30 * 1024 * 1024 then 'file too large' end as reject_reason,
       ({_EXT.format(p='raw_path')} in ('.pdf', '.txt', '.docx', '.md')
        and octet_length(encode(text)) <= 30 * 1024 * 1024) as admitted
from v_documents
"""


@register("s3_admission", _S3_SQL)
def s3_admission(spark, sf_dir):
    """S3: admission by extension (case-insensitive) and size."""
    d = Fixture(spark, sf_dir).documents().withColumn("length", F.octet_length("text"))
    return files.admit(d, "raw_path", "length").select("id", "extension", "reject_reason", "admitted")


_S4_SQL = duck_cte("v_documents") + f"""
, f as (select id, text, regexp_extract(raw_path, '([^/]*)$', 1) as fname,
               {_EXT.format(p='raw_path')} as ext from v_documents)
select id, ext as extension,
  case when ext in ('.txt', '.md') then text
       when ext = '.pdf' then {placeholder_sql(PDF_TEXT, 'fname')}
       when ext in ('.doc', '.docx') then {placeholder_sql(DOC_TEXT, 'fname')}
       else '[File Content] Filename: ' || fname || chr(10) || 'Unsupported file type for text extraction: ' || ext
  end as extracted
from f
"""


@register("s4_extract_text", _S4_SQL)
def s4_extract_text(spark, sf_dir):
    """Text extraction by extension from the document bytes."""
    d = Fixture(spark, sf_dir).documents().select(
        "id", F.encode("text", "UTF-8").alias("content"),
        F.regexp_extract("raw_path", "([^/]*)$", 1).alias("fname"))
    return d.select("id", files.extension(F.col("fname")).alias("extension"),
                    files.extract_text(F.col("content"), F.col("fname")).alias("extracted"))


_G8_SQL = duck_cte("v_documents") + """
select id, substr(sha256(text), 1, 16) as content_hash,
       user_id || '_' || cast(cast(epoch(created_at) as bigint) as varchar) || '_' || substr(sha256(text), 1, 16) as file_key,
       cast(count(*) over (partition by substr(sha256(text), 1, 16)) as bigint) as same_content
from v_documents
"""


@register("g8_file_keys", _G8_SQL)
def g8_file_keys(spark, sf_dir):
    """Content hash, formatted file key, size of the duplicate-content group."""
    d = Fixture(spark, sf_dir).documents()
    k = d.select("id", files.content_hash(F.col("text")).alias("content_hash"),
                 files.file_key(F.col("user_id"), F.col("created_at"), F.col("text"),
                                epoch=files.wall_epoch(F.col("created_at"))).alias("file_key"))
    # group sizes by aggregate + join (a hot duplicate group is counted map-side)
    n = k.groupBy("content_hash").agg(F.count(F.lit(1)).cast("bigint").alias("same_content"))
    return k.join(n, "content_hash").select("id", "content_hash", "file_key", "same_content")


_G9_SQL = duck_cte("v_documents") + """
select id, '/data/main/docs/raw/' || filename as upload_path,
       regexp_replace('/data/main/docs/raw/' || filename, '/[^/]+$', '') || '/processed' as processed_path
from v_documents
"""


@register("g9_paths", _G9_SQL)
def g9_paths(spark, sf_dir):
    """Upload path composition and processed-output path."""
    d = Fixture(spark, sf_dir).documents()
    up = files.upload_path("/data", "main", "docs", "raw", F.col("filename"))
    return d.select("id", up.alias("upload_path"), files.processed_path(up).alias("processed_path"))


# ---------------------------------------------------------------- parse

_P1_SQL = """
select doc_id, doc_id % 43 <> 0 as parse_ok,
       case when doc_id % 43 = 0 then null when doc_id % 41 = 0 then 0
            else cast(ceil(n_chars / 2000.0) as bigint) end as n_pages,
       doc_id % 43 <> 0 and doc_id % 41 <> 0 and doc_id % 37 = 0 as corrupted
from documents
"""


def _parsed(spark, sf_dir):
    return parse.parse_result(Fixture(spark, sf_dir).parsed())


@register("p1_parse_result", _P1_SQL)
def p1_parse_result(spark, sf_dir):
    """Parse JSON to variant; page count and corruption flag per document."""
    p = _parsed(spark, sf_dir)
    n = F.expr("cast(array_size(variant_get(pages, '$', 'array<variant>')) as bigint)")
    return p.select("doc_id", F.col("parsed_json").isNotNull().alias("parse_ok"),
                    n.alias("n_pages"),
                    F.coalesce(F.col("_corrupted_data").isNotNull(), F.lit(False)).alias("corrupted")) \
        .withColumn("corrupted", F.when(F.col("parse_ok"), F.col("corrupted")).otherwise(F.lit(False)))


_P2_SQL = """
select doc_id, case when doc_id % 43 = 0 then 'unparsable' else 'corrupted' end as reason
from documents where doc_id % 43 = 0 or (doc_id % 41 <> 0 and doc_id % 37 = 0)
"""


@register("p2_quarantine", _P2_SQL)
def p2_quarantine(spark, sf_dir):
    """Rows set aside (unparsable JSON or corrupted data)."""
    _, bad = parse.split_quarantine(_parsed(spark, sf_dir))
    return bad.select("doc_id", "reason")


_P5_SQL = duck_cte("v_pages") + """
select doc_id, cast(page_id as varchar) as page_id, cast(page_id as bigint) as chunk_index,
  'Content: [' || content || ']' || chr(10) ||
  'Footer: [' || case when page_id % 2 = 0 then source else '' end || ']' || chr(10) ||
  'Header: [' || lang || ']' || chr(10) ||
  'ID: [' || cast(page_id as varchar) || ']' || chr(10) ||
  'Page Number: [' || cast(page_id + 1 as varchar) || ']' as text
from v_pages
where doc_id % 43 <> 0 and doc_id % 41 <> 0 and doc_id % 37 <> 0
"""


@register("p5_page_chunks", _P5_SQL)
def p5_page_chunks(spark, sf_dir):
    """P3+P4+P5 = C1: typed pages, one row per page, labelled page text."""
    out = parse.page_chunks(Fixture(spark, sf_dir).parsed(), key_cols=("doc_id",))
    return out.select("doc_id", "page_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "text")
