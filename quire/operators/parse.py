"""Parse results to typed pages and page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The read schema of one parsed page, as the parse result has it.
PAGE_SCHEMA = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("footer", T.StringType()),
    T.StructField("header", T.StringType()),
    T.StructField("id", T.IntegerType()),
    T.StructField("page_number", T.IntegerType()),
])
PAGES_TYPE = T.ArrayType(PAGE_SCHEMA)


def parse_result(df: DataFrame, json_col: str = "parsed") -> DataFrame:
    """JSON text to variant and the three paths of the parse result.

    Adds ``parsed_json`` (variant, null when the text does not parse),
    ``pages`` and ``elements`` (variant) and ``_corrupted_data`` (string)."""
    v = F.try_parse_json(F.col(json_col))
    return (df.withColumn("parsed_json", v)
            .withColumn("pages", F.try_variant_get(F.col("parsed_json"), "$.document.pages", "variant"))
            .withColumn("elements", F.try_variant_get(F.col("parsed_json"), "$.document.elements", "variant"))
            .withColumn("_corrupted_data",
                        F.try_variant_get(F.col("parsed_json"), "$.document._corrupted_data", "string")))


def quarantine_reason(df: DataFrame) -> Column:
    """Why a parsed row is set aside (null for good rows)."""
    return (F.when(F.col("parsed_json").isNull(), F.lit("unparsable"))
            .when(F.col("_corrupted_data").isNotNull(), F.lit("corrupted")))


def split_quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` frames of a P1 result; ``bad`` carries ``reason``."""
    r = parsed.withColumn("reason", quarantine_reason(parsed))
    return r.filter(F.col("reason").isNull()).drop("reason"), r.filter(F.col("reason").isNotNull())


def typed_pages(df: DataFrame) -> DataFrame:
    """Variant pages to ``array<struct<content,footer,header,id,page_number>>``."""
    return df.withColumn("pages_array", F.from_json(F.to_json(F.col("pages")), PAGES_TYPE))


def explode_pages(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per page with ``page_pos``; documents without pages vanish
    unless ``keep_empty`` (then one row with a null page)."""
    fn = F.posexplode_outer if keep_empty else F.posexplode
    cols = [c for c in df.columns if c not in ("pages_array",)]
    return df.select(*cols, fn("pages_array").alias("page_pos", "page_chunk"))


def page_text(page: Column) -> Column:
    """P5: the labelled five-line page text; null parts render as ``[]``."""
    def part(label: str, v: Column) -> Column:
        return F.concat_ws("", F.lit(f"{label}: ["), v, F.lit("]"))
    return F.concat_ws(
        "\n",
        part("Content", page["content"]),
        part("Footer", page["footer"]),
        part("Header", page["header"]),
        part("ID", page["id"].cast("string")),
        part("Page Number", page["page_number"].cast("string")))


def page_chunks(parsed: DataFrame, json_col: str = "parsed",
                key_cols: tuple[str, ...] = ("path", "user_id")) -> DataFrame:
    """One chunk per page of the good parse results:
    ``(*key_cols, page_id, chunk_index, text)``."""
    good, _ = split_quarantine(parse_result(parsed, json_col))
    pages = explode_pages(typed_pages(good))
    return pages.select(*key_cols,
                        F.col("page_chunk.id").cast("string").alias("page_id"),
                        F.col("page_pos").alias("chunk_index"),
                        page_text(F.col("page_chunk")).alias("text"))
