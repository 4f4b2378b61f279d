"""The operators as pipeline stages on a table like ``documents``.

Each stage but the last takes and returns the columns of its input (``doc_id``,
``text``, ``n_chars`` and whatever else there is) and lets its decisions take
effect: rows go, or texts change and ``n_chars`` with them. Rows with a null
id are judged by the stages that look at one text and kept by those that
compare documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import jaccard, packing, secrets, suffixes, toxicity
from quire.llm.common import give_back, materialize

#: Near duplicates of a corpus: five-word shingles, similarity 0.8 or more.
SHINGLE_WORDS = 5
SHINGLE_PERCENT = 80


def _as_before(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).cast(like.schema[c].dataType).alias(c) for c in like.columns])


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    model = toxicity.fit(docs, labels)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            e = pd.Series([min(60.0, model.evidence(model.passages(t))) for t in texts], dtype=float)
            yield pd.Series(model.probability(e.to_numpy()))
        model.known.clear()
        give_back()

    return docs.filter(score("text") < toxicity.THRESHOLD)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of each class of near copies the smallest id stays."""
    got = jaccard.near_classes(docs, size=SHINGLE_WORDS, percent=SHINGLE_PERCENT)
    gone = got.filter("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Repeated strings are cut out of texts (whole characters remain);
    documents of which nothing remains go."""
    # other columns go along under names that can't clash with the operator's;
    # a null text stays null; one that was empty before stays
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    names = [f"_other{i}" for i in range(len(others))]
    src = docs.select("doc_id", "text", F.col("text").isNull().alias("_null"),
                      *[F.col(f"`{c}`").alias(n) for c, n in zip(others, names)])
    got = suffixes.removals(src, carry=(*names, "_null"), as_text=True)
    text = F.when(~F.col("_null"), F.col("kept"))
    got = got.select("doc_id", text.alias("text"), "n_bytes", *names).filter((F.col("n_bytes") == 0) | (F.length("text") > 0))
    back = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text"),
            **{c: F.col(n) for c, n in zip(others, names)}}
    return got.select(*[back[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """Every secret found is replaced by a mark."""
    net = secrets.train(materialize(secrets.scan(docs), "secret-candidates"))

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([secrets.redact(t, secrets.all_spans(t, net)) if t else t for t in texts], dtype=object)
        give_back()

    got = docs.withColumn("text", masked("text"))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.char_length("text"))
    return _as_before(got, docs)


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path, keep_ids=False)
