"""Prompt tables, answer parsing, titles and labels.

All layouts are byte-exact string assembly from ordered, bounded lists (the
last few messages, the top three context chunks) kept per conversation with
``array_sort`` over ``(position, text)`` structs; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ellipsize, py_strip

# Prompt texts.
SYSTEM_PROMPT = ("You are a helpful document intelligence assistant. "
                 "You can answer questions about uploaded documents and provide general assistance.")
SYSTEM_PROMPT_2 = ("You are a helpful AI assistant that specializes in document analysis and "
                   "intelligent conversation. Use the provided context from documents to answer "
                   "questions accurately and comprehensively.")
SUMMARY_HEADER = ("Please analyze this conversation and provide:\n1. A brief summary (2-3 sentences)\n"
                  "2. A short, descriptive title (max 50 characters)\n\nConversation:\n")
SUMMARY_FOOTER = "\nPlease format your response as:\nSummary: [summary]\nTitle: [title]"
DEFAULT_TITLE = "New Conversation"
# Headings and roles of the two prompt layouts.
CHAT_CONTEXT, CHAT_DOCUMENT, CHAT_HISTORY, CHAT_ANSWER = ("\n\nRelevant document context:", "\nDocument ", "\n\nConversation:",
                                                          "\n\nAssistant:")
AGENT_CONTEXT, AGENT_DOCUMENT, AGENT_HISTORY = "\nRelevant Document Context:", "\nContext ", "\nRecent Conversation:"
AGENT_QUESTION, AGENT_ANSWER, AGENT_USER, AGENT_OTHER = "\nHuman: ", "\nAssistant:", "Human", "Assistant"


def _ordered(df: DataFrame, key: str, pos: str, item: Column, name: str) -> DataFrame:
    """Per key, the ``item`` strings ordered by ``pos`` (a bounded list)."""
    return (df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), item.alias("s"))))
                                .alias("_l"))
            .select(key, F.transform("_l", lambda x: x["s"]).alias(name)))


def _empty() -> Column:
    return F.array().cast("array<string>")


def chat_prompt(conversations: DataFrame, last5: DataFrame, context: DataFrame,
                conv: str = "conv_id") -> DataFrame:
    """G1: prompt per conversation from its last 5 messages (``pos``) and up
    to 3 context chunks (``position``, ``content``). Adds A3 columns
    ``context_docs_count`` and ``prompt_length``."""
    msg = _ordered(last5, conv, "pos",
                   F.concat(F.lit("\n"), F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit(""))), "_m")
    ctx = _ordered(context.filter(F.col("position") <= 3), conv, "position",
                   F.concat(F.lit(CHAT_DOCUMENT), F.col("position").cast("string"), F.lit(": "),
                            F.substring(F.coalesce("content", F.lit("")), 1, 500)), "_c")
    j = conversations.select(conv).join(msg, conv, "left").join(ctx, conv, "left")
    n_ctx = F.size(F.coalesce("_c", _empty()))
    ctx_block = F.when(n_ctx > 0, F.concat(F.lit(CHAT_CONTEXT), F.array_join("_c", ""))) \
        .otherwise(F.lit(""))
    prompt = F.concat(F.lit(SYSTEM_PROMPT), ctx_block, F.lit(CHAT_HISTORY),
                      F.array_join(F.coalesce("_m", _empty()), ""), F.lit(CHAT_ANSWER))
    return j.select(conv, prompt.alias("prompt"), n_ctx.cast("bigint").alias("context_docs_count")) \
        .withColumn("prompt_length", F.length("prompt").cast("bigint"))


def agent_prompt(question: DataFrame, last6: DataFrame, counts: DataFrame, context: DataFrame,
                 conv: str = "conv_id") -> DataFrame:
    """Second layout joined by newlines: ``Context i:`` blocks cut at 500
    with ``...`` only when longer; the last 6 messages (Human/Assistant) only
    when the conversation has more than one; then the question."""
    role = F.when(F.col("role") == "user", F.lit(AGENT_USER)).otherwise(F.lit(AGENT_OTHER))
    msg = _ordered(last6, conv, "pos", F.concat(role, F.lit(": "), F.coalesce("text", F.lit(""))), "_m")
    c = context.filter(F.col("position") <= 3)
    ctx = _ordered(c, conv, "position",
                   F.concat(F.lit(AGENT_DOCUMENT), F.col("position").cast("string"), F.lit(":\n"),
                            ellipsize(F.coalesce("content", F.lit("")), 500)), "_c")
    j = question.join(counts, conv, "left").join(msg, conv, "left").join(ctx, conv, "left")
    ctx_part = F.when(F.size(F.coalesce("_c", _empty())) > 0,
                      F.concat(F.array(F.lit(AGENT_CONTEXT)), F.col("_c"))).otherwise(_empty())
    hist = F.when(F.col("n_messages") > 1,
                  F.concat(F.array(F.lit(AGENT_HISTORY)), F.coalesce("_m", _empty()))).otherwise(_empty())
    parts = F.concat(F.array(F.lit(SYSTEM_PROMPT_2)), ctx_part, hist,
                     F.array(F.concat(F.lit(AGENT_QUESTION), F.coalesce("text", F.lit(""))), F.lit(AGENT_ANSWER)))
    return j.select(conv, F.array_join(parts, "\n").alias("prompt"))


def summary_prompt(last5: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Summarisation prompt over the last 5 messages, each cut at 200."""
    m = _ordered(last5, conv, "pos",
                 F.concat(F.initcap("role"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 200),
                          F.lit("\n")), "_m")
    return m.select(conv, F.concat(F.lit(SUMMARY_HEADER), F.array_join("_m", ""), F.lit(SUMMARY_FOOTER))
                    .alias("prompt"))


def parse_answer(answer: Column) -> tuple[Column, Column]:
    """``(summary, title)`` from a model answer: the last line starting
    ``Summary:`` / ``Title:``, every repeat of the tag in it removed, stripped;
    title defaults to ``New Conversation`` and summary to ``''``."""
    lines = F.split(F.coalesce(answer, F.lit("")), "\n", -1)

    def last(tag: str) -> Column:
        hit = F.filter(lines, lambda s: s.startswith(tag))
        return F.when(F.size(hit) > 0, py_strip(F.replace(F.element_at(hit, -1), F.lit(tag), F.lit(""))))

    summary = F.coalesce(last("Summary:"), F.lit(""))
    t = last("Title:")
    title = F.when(t.isNull() | (t == ""), F.lit(DEFAULT_TITLE)).otherwise(t)
    return summary, title


def title_from_documents(conversations: DataFrame, documents: DataFrame) -> DataFrame:
    """Given title; else ``Chat with a, b`` (+ `` and N more``) from the
    names of the known documents in ``doc_ids`` order; ``Document Chat`` when
    none is known; ``New Conversation`` without ids."""
    from pyspark.sql import Window
    e = conversations.select("id", F.posexplode("doc_ids").alias("pos", "doc_id"))
    known = e.join(documents.select(F.col("id").alias("doc_id"), "filename"), "doc_id")
    # only the first two names and the count are needed: a top-2 window
    # (WindowGroupLimit) and a count, never the whole list of names
    first2 = (known.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("pos")))
              .filter(F.col("_r") <= 2)
              .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "filename"))).alias("_n"))
              .select("id", F.transform("_n", lambda s: s["filename"]).alias("_names")))
    counts = known.groupBy("id").agg(F.count(F.lit(1)).alias("_known"))
    j = conversations.join(first2, "id", "left").join(counts, "id", "left")
    n = F.coalesce("_known", F.lit(0))
    chat = F.concat(F.lit("Chat with "), F.array_join(F.col("_names"), ", "),
                    F.when(n > 2, F.concat(F.lit(" and "), (n - 2).cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    derived = (F.when(F.size(F.coalesce("doc_ids", _empty())) == 0, F.lit(DEFAULT_TITLE))
               .when(n == 0, F.lit("Document Chat")).otherwise(chat))
    given = F.col("title").isNotNull() & (F.col("title") != "")
    return j.withColumn("new_title", F.when(given, F.col("title")).otherwise(derived)).drop("_names", "_known")


def display_title(title: Column, width: int = 22) -> Column:
    """First ``width`` characters plus ``...`` when longer."""
    return ellipsize(title, width)


# Labels of the rule-based fallback reply, first match wins.
LABELS = ("context", "greeting", "document", "help", "other")


def fallback_label(text: Column, has_context: Column) -> Column:
    """Reply class of a user message (substring tests, so ``this``
    counts as containing ``hi``)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.when(has_context, F.lit("context"))
            .when(low.contains("hello") | low.contains("hi"), F.lit("greeting"))
            .when(low.contains("document"), F.lit("document"))
            .when(low.contains("help"), F.lit("help"))
            .otherwise(F.lit("other")))
