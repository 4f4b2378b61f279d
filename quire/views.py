"""Fixture bindings: the driver's tables seen as the reference's data model.

Each view is one SQL text that runs unchanged in Spark SQL and in DuckDB
(the oracle): ``{documents}``-style placeholders become a Parquet path in
Spark and the pre-registered table name in DuckDB. The same text on both
sides means the oracle and the operator start from identical rows.

No view drops rows of its base table to keep checks cheap: every document,
embedding, message and event takes part at every scale.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

VIEW_SQL = {
    "v_users": """
select cast(c_custkey as string) as id, c_name as username,
       cast('2024-01-01 00:00:00' as timestamp) + interval '1' minute * c_custkey as created_at
from {customer}""",
    "v_documents": """
select cast(doc_id as string) as id, cast(1 + doc_id % 50 as string) as user_id,
       concat('/raw/', source, '/', cast(doc_id as string),
              case doc_id % 5 when 0 then '.txt' when 1 then '.md' when 2 then '.PDF'
                              when 3 then '.docx' else '.exe' end) as raw_path,
       concat(source, '_', cast(doc_id as string)) as filename,
       case when doc_id % 10 = 0 then 'failed' when doc_id % 10 in (1, 2) then 'processing'
            when doc_id % 10 = 3 then 'uploaded' else 'processed' end as status,
       text, n_chars, lang, source,
       cast('2024-01-01 00:00:00' as timestamp) + interval '1' minute * (doc_id % 97) as created_at
from {documents}""",
    # chunks: every document is one chunk with its whole text; its vector is
    # that of row doc_id % number of embeddings, so equal distances occur
    # wherever there are more documents than vectors
    "v_chunks": """
select cast(d.doc_id as string) as id, cast(d.doc_id as string) as doc_id,
       cast(0 as int) as chunk_index, d.text as content, e.embedding
from (select doc_id, text, doc_id % (select count(*) from {embeddings}) as vec_id from {documents}) d
join {embeddings} e on e.vec_id = d.vec_id""",
    # queries: every embedding queries all chunks (its own row excluded)
    "v_queries": """
select vec_id as qid, embedding from {embeddings}""",
    "v_messages": """
select concat(cast(conv_id as string), '-', cast(turn as string)) as id,
       cast(conv_id as string) as conv_id, turn, role, text,
       cast('2024-01-01 00:00:00' as timestamp) + interval '1' minute * (conv_id * 60 + turn) as created_at
from {conversations}""",
    "v_conversations_core": """
select cast(conv_id as string) as id, cast(1 + conv_id % 50 as string) as user_id,
       case when conv_id % 7 = 0 then null when conv_id % 7 = 1 then 'New Conversation'
            else concat('Conversation about topic number ', cast(conv_id as string)) end as title,
       conv_id % 4 as n_docs,
       cast('2024-01-01 00:00:00' as timestamp) + interval '1' minute * (conv_id * 60 + max(turn)) as updated_at
from {conversations} group by conv_id""",
    # documents of a conversation: positions 0 .. conv_id % 4 - 1
    "v_conv_docs_spark": """
select cast(conv_id as string) as conv_id, pos,
       case when pos = 2 and conv_id % 5 = 0 then 'missing'
            else cast((conv_id * 7 + pos * 13) % (select count(*) from {documents}) as string) end as doc_id
from (select conv_id, explode(if(conv_id % 4 > 0, sequence(0, cast(conv_id % 4 as int) - 1), array())) as pos
      from (select distinct conv_id from {conversations}))""",
    "v_conv_docs_duck": """
select cast(conv_id as string) as conv_id, pos,
       case when pos = 2 and conv_id % 5 = 0 then 'missing'
            else cast((conv_id * 7 + pos * 13) % (select count(*) from {documents}) as string) end as doc_id
from (select conv_id, unnest(range(0, cast(conv_id % 4 as int))) as pos
      from (select distinct conv_id from {conversations}))""",
    # pages: each document cut into 2,000-character pages covering all of it
    "v_pages_spark": """
select doc_id, k as page_id, substring(text, 1 + 2000 * k, 2000) as content, lang, source
from (select doc_id, text, lang, source,
             explode(filter(sequence(0, cast(ceil(length(text) / 2000.0) as int)), k -> 2000 * k < length(text))) as k from {documents})""",
    "v_pages_duck": """
select doc_id, k as page_id, substring(text, 1 + 2000 * k, 2000) as content, lang, source
from (select doc_id, text, lang, source,
             unnest(range(0, cast(ceil(length(text) / 2000.0) as int))) as k from {documents})""",
    # scope of a search query: ten documents of all, chosen by rule
    "v_scope_spark": """
select vec_id as qid, cast((vec_id * 7 + j * 13) % (select count(*) from {documents}) as string) as doc_id
from (select vec_id, explode(sequence(0, 9)) as j from {embeddings})""",
    "v_scope_duck": """
select vec_id as qid, cast((vec_id * 7 + j * 13) % (select count(*) from {documents}) as string) as doc_id
from (select vec_id, unnest(range(0, 10)) as j from {embeddings})""",
}


def duck_cte(*names: str) -> str:
    """``WITH`` clause defining the named views for the DuckDB oracle."""
    parts = []
    for n in names:
        key = {"v_pages": "v_pages_duck", "v_conv_docs": "v_conv_docs_duck", "v_scope": "v_scope_duck"}.get(n, n)
        body = VIEW_SQL[key].format(**{t: t for t in BASE_TABLES})
        parts.append(f"{n} as ({body})")
    return "with " + ",\n".join(parts) + "\n"


def more_views(*names: str) -> str:
    """Further view definitions to append to an existing ``WITH`` clause."""
    return "".join(", " + duck_cte(n)[len("with "):] for n in names)


class Fixture:
    """Lazily bound views over ``/root/testdata/<sf>`` for one session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    def _sql(self, key: str) -> DataFrame:
        paths = {t: f"parquet.`{self.sf_dir}/{t}.parquet`" for t in BASE_TABLES}
        return self.spark.sql(VIEW_SQL[key].format(**paths))

    def view_over(self, key: str, **tables: str) -> DataFrame:
        """The view ``key`` over other tables (e.g. a stream's temp view)."""
        paths = {t: f"parquet.`{self.sf_dir}/{t}.parquet`" for t in BASE_TABLES}
        paths.update(tables)
        return self.spark.sql(VIEW_SQL[key].format(**paths))

    def users(self): return self._sql("v_users")
    def documents(self): return self._sql("v_documents")
    def chunks(self): return self._sql("v_chunks")
    def queries(self): return self._sql("v_queries")
    def messages(self): return self._sql("v_messages")
    def conv_docs(self): return self._sql("v_conv_docs_spark")
    def pages(self): return self._sql("v_pages_spark")
    def scope(self): return self._sql("v_scope_spark")

    def conversations(self) -> DataFrame:
        """Core conversations with ``doc_ids`` in position order (null when none)."""
        core = self._sql("v_conversations_core")
        docs = (self.conv_docs().groupBy("conv_id")
                .agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))).alias("_d"))
                .select(F.col("conv_id").alias("id"), F.transform("_d", lambda s: s["doc_id"]).alias("doc_ids")))
        return core.join(docs, "id", "left")

    def parsed(self) -> DataFrame:
        """``(doc_id, path, user_id, parsed)``: parse-result JSON text per document.

        Pages come from ``v_pages``; ``footer`` only on even pages;
        ``_corrupted_data`` when ``doc_id % 37 = 0``; no pages when
        ``doc_id % 41 = 0``; unparsable text when ``doc_id % 43 = 0``.
        """
        p = self.pages().select(
            "doc_id", "page_id",
            F.struct(F.col("content"),
                     F.when(F.col("page_id") % 2 == 0, F.col("source")).alias("footer"),
                     F.col("lang").alias("header"),
                     F.col("page_id").cast("int").alias("id"),
                     (F.col("page_id") + 1).cast("int").alias("page_number")).alias("page"))
        per_doc = (p.groupBy("doc_id")
                   .agg(F.array_sort(F.collect_list(F.struct("page_id", "page"))).alias("_p"))
                   .select("doc_id", F.transform("_p", lambda s: s["page"]).alias("pages")))
        d = self.documents().select(F.col("id").cast("bigint").alias("doc_id"), "raw_path", "user_id")
        j = d.join(per_doc, "doc_id", "left")
        doc = (F.when(F.col("doc_id") % 41 == 0, F.to_json(F.struct(F.struct(F.array().cast("array<string>").alias("pages")).alias("document"))))
               .when(F.col("doc_id") % 37 == 0,
                     F.to_json(F.struct(F.struct(F.col("pages"), F.lit("x").alias("_corrupted_data")).alias("document"))))
               .otherwise(F.to_json(F.struct(F.struct(F.col("pages")).alias("document")))))
        parsed = F.when(F.col("doc_id") % 43 == 0, F.lit("{bad")).otherwise(doc)
        return j.select("doc_id", F.col("raw_path").alias("path"), "user_id", parsed.alias("parsed"))
