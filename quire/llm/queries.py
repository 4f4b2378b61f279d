"""The named queries of this package, one ``opN_<name>`` per operator.

Each applies its operator with production parameters to its whole table and
derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@_add
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.pieces import encode
    return encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), keep_ids=False)


@_add
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep_ids=False)


@_add
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality import filter_quality
    got = filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


@_add
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.secrets import digest, find_secrets
    return digest(find_secrets(table(spark, sf_dir, "documents")))


@_add
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import THRESHOLD, fit, held_out, score
    docs = table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out().alias("held_out"), "score",
                      F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


@_add
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.licenses import report, scan
    return report(scan(table(spark, sf_dir, "documents")))


@_add
def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.neighbours import search
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_add
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.warc import round_trip
    got = round_trip(table(spark, sf_dir, "pages"))
    return got.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
best AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS target FROM p)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND target <> page_id THEN target END AS refers_to
FROM best
"""


@_add
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.jaccard import near_classes
    return near_classes(table(spark, sf_dir, "documents"))


@_add
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.suffixes import removals
    got = removals(table(spark, sf_dir, "documents"), keep_text=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      "kept_sha256")


@_add
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.digests import copies
    return copies(table(spark, sf_dir, "documents"), keep="largest")


ORACLES["op11_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@_add
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.periods import find_runs, planted
    got = find_runs(table(spark, sf_dir, "documents"), keep_text=False, rewrite=planted)
    return got.select("doc_id", "n_runs", "start", "length", "period",
                      F.expr("1000 * length div period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@_add
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents")).withColumnRenamed("stratum", "lang")


ORACLES["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (
  SELECT lang, n, array_to_string(string_split(phrase, ' ')[1:k - 1], ' ') AS phrase FROM f WHERE k > 2
  UNION ALL SELECT lang, n, array_to_string(string_split(phrase, ' ')[2:k], ' ') FROM f WHERE k > 2),
free AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (
  SELECT 1 FROM inner_ o WHERE o.lang = f.lang AND o.phrase = f.phrase AND o.n >= f.n)),
cuts AS (SELECT lang, phrase, n AS a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS head,
                array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') AS tail
         FROM free, (SELECT unnest([1, 2, 3, 4]) AS cut) WHERE cut < k),
scored AS (SELECT c.lang, c.phrase, c.cut, c.a, h.n AS l, t.n AS r, totals.n,
                  CAST((1000::HUGEINT * c.a * totals.n) // (h.n::HUGEINT * t.n) AS BIGINT) AS score
           FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail
           JOIN totals ON totals.lang = c.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@_add
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of ``corpus_pipeline.py`` in a row."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
