"""The chat-turn plan for all conversations at once (W2 -> E3 -> T1 -> V4 ->
W5 -> W1 -> G1): one lazy plan from messages, conversations, documents and
chunks to a prompt table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import dialogue, embedding, lookup, prompts
from quire.operators.search import knn


def retrieve_context(messages: DataFrame, conversations: DataFrame, documents: DataFrame,
                     chunks: DataFrame, k: int = 3, empty_scope: str = "owned_processed",
                     width: int = embedding.DEFAULT_WIDTH) -> DataFrame:
    """``(conv_id, position, chunk_id, doc_id, distance, content)``: the ``k``
    chunks nearest (cosine) to each conversation's last user message, within
    its search scope.

    Texts are embedded with the default embedder as raw signed counts (cosine
    does its own normalisation). ``chunks`` that carry a ``content_hash`` come
    from the chunk store with their vectors; of others each distinct text is
    embedded once (E4).
    """
    q = dialogue.last_user_message(messages)
    qe = embedding.hash_embed(q.select("conv_id", "text"), "conv_id", "text", width, normalize=False)
    if "content_hash" in chunks.columns:
        ce = chunks.select("id", "embedding")
    else:
        sp = embedding.embed_distinct(chunks.select("id", "content"), "id", "content", width, normalize=False)
        ce = embedding.densify(sp.select("id", "bucket", "value"), "id", width)
    scope, item_keys = lookup.search_scope_keys(conversations, documents, empty_scope)
    # each chunk under its document's key and (if processed) its owner's key;
    # a chunk reached under two keys of one conversation counts once
    ce = chunks.select("id", "doc_id").join(item_keys, "doc_id").join(ce, "id")
    hits = knn(qe, ce, k=k, metric="cosine", query_id="conv_id", scope=scope, scope_key="scope_key",
               dim=width, dedupe=True, keys_per_item=2)
    return (hits.join(chunks.select("id", "doc_id", "content"), "id")
            .select("conv_id", F.col("rank").alias("position"), F.col("id").alias("chunk_id"),
                    "doc_id", "distance", "content"))


def chat_prompts(messages: DataFrame, conversations: DataFrame, documents: DataFrame,
                 chunks: DataFrame, **kw) -> DataFrame:
    """G1 (+A3) for every conversation."""
    ctx = retrieve_context(messages, conversations, documents, chunks, **kw)
    last5 = dialogue.last_messages(messages, 5)
    convs = conversations.select(F.col("id").alias("conv_id"))
    return prompts.chat_prompt(convs, last5, ctx)
