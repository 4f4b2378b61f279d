"""License scan by a positional rare-token index (native Spark expressions).

Licence texts, notices and short forms (``licence_texts``) are a small fixed
table of word sequences. From them comes a positional index: for each
version's ``RARE`` highest-IDF words (IDF over the documents; ties by the
number of versions, then the longer word) the places where it stands. A file's
words are looked up in the index; every hit proposes a start ``file position -
version position``. The postings of the version are intersected there by
relative position: each is looked up at its distance from the start, and the
place has the share of the version's rare-word weight that stands where it
should. A start that several hits propose is judged for the first posting that
holds. It counts when its share reaches ``MIN_SHARE``, every mandatory key
phrase of the version stands word for word at its own distance from the start,
and none of the words that may not follow the version does.

One aggregate counts the documents with each template word (a row a word). The
work on a file is a projection whose steps grow with the file's index words:
no shuffle, no Python. Base phrases are found by the same word positions.

Defined results: null or empty text has no words and no labels; rows with
null or repeated ids are scanned one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.licence_texts import TEXTS, Version

#: The base phrases and their labels.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
RARE = 6
MIN_SHARE = 0.5
_WORD = re.compile("[a-z0-9]+")


def words_of(text: str) -> list[str]:
    """The words of a template, as ``word_array`` has those of a file."""
    return _WORD.findall(text.lower())


def versions(templates: dict[str, list[Version]] = TEXTS) -> list[tuple[str, list[str], Version]]:
    """``(label, words, version)`` of all versions."""
    return [(label, words_of(v.text), v) for label, vs in templates.items() for v in vs]


def build_index(df: dict[str, int], n: int, templates: dict[str, list[Version]] = TEXTS,
                rare: int = RARE) -> list[list[tuple[str, int, float]]]:
    """For each version the postings ``(word, position, weight)`` of its
    rarest words, where ``df`` of ``n`` documents have a word; a version's
    weights sum to 1 over its words' places."""
    split = [ws for _, ws, _ in versions(templates)]
    shared = Counter(w for ws in split for w in set(ws))
    out = []
    for ws in split:
        idf = {w: math.log((2 + n) / (1 + df.get(w, 0))) for w in set(ws)}
        top = sorted(idf, key=lambda w: (-idf[w], shared[w], -len(w), w))[:rare]
        total = sum(idf[w] * ws.count(w) for w in top)
        out.append([(w, p, idf[w] / total) for w in top for p, x in enumerate(ws) if x == w])
    return out


def word_array(text_col: str) -> Column:
    """The words of a text: pieces between ASCII characters that are neither
    letters nor digits (the two ends of the split may be empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-/:-`{-\x7f]+"),
                    lambda w: w != "")


def document_frequency(docs: DataFrame, text_col: str = "text",
                       templates: dict[str, list[Version]] = TEXTS) -> tuple[dict[str, int], int]:
    """How many documents have each template word, and how many there are."""
    vocab = sorted({w for _, ws, _ in versions(templates) for w in ws})
    has = F.array_intersect(word_array(text_col), F.array(*[F.lit(w) for w in vocab]))
    got = (docs.select(F.explode(F.concat(F.array(F.lit("")), has)).alias("w")).groupBy("w").count()
           .collect())  # a row for each template word, and "" for all documents
    df = {r["w"]: r["count"] for r in got}
    return df, df.pop("", 0)


def _str(v: str) -> str:
    return "'" + v + "'"


def _array(items: list[str], kind: str) -> str:
    return f"cast(array({', '.join(items)}) as array<{kind}>)"


def _phrase_at(words: str, phrase: str) -> str:
    """SQL: start positions (from 0) of ``phrase`` in the array ``words``.
    The rarest-looking (longest) word is looked up first."""
    ws = phrase.split()
    k = max(range(len(ws)), key=lambda i: len(ws[i]))
    same = " and ".join(f"get({words}, cast(i + {j - k} as int)) <=> {_str(w)}" for j, w in enumerate(ws) if j != k)
    return (f"transform(filter(filter(hits, h -> h.w = {_str(ws[k])}).p, i -> {same}), i -> i - {k})")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[Version]] = TEXTS,
         base: dict = BASE, min_share: float = MIN_SHARE, index: list[list[tuple[str, int, float]]] | None = None) -> DataFrame:
    """``(<id_col>, n_words, base_places, places)`` of every row.
    ``base_places``: array of ``(label, start)``; ``places``: array of
    ``(label, start, share)`` found by the index and verified. ``index`` is
    built from the documents by default."""
    held = versions(templates)
    if index is None:
        index = build_index(*document_frequency(docs, text_col, templates), templates)
    anchors = {max(p.split(), key=len) for p in base.values()}
    known = sorted({w for ps in index for w, _, _ in ps} | anchors)
    df = docs.select(F.col(id_col).alias("id"), word_array(text_col).alias("words"))
    df = df.withColumn("hits", F.expr("filter(transform(words, (w, p) -> named_struct('w', w, 'p', p)), "
                                      f"h -> h.w in ({', '.join(_str(w) for w in known)}))"))
    # word -> its postings; version -> its postings, the words of its key
    # phrases, the words that may not follow it
    posts: dict[str, list[str]] = {}
    for t, ps in enumerate(index):
        for j, (w, o, _) in enumerate(ps):
            posts.setdefault(w, []).append(f"named_struct('t', {t}, 'j', {j}, 'o', {o})")
    by_word = "map(" + ", ".join(f"{_str(w)}, array({', '.join(p)})" for w, p in sorted(posts.items())) + ")" if posts else "null"
    rare = _array([_array([f"named_struct('w', {_str(w)}, 'o', {o}, 's', cast({s!r} as double))" for w, o, s in ps],
                          "struct<w:string,o:int,s:double>") for ps in index], "array<struct<w:string,o:int,s:double>>")
    keys, bans = [], []
    for _, ws, v in held:
        at = []
        for p in v.keys:
            k = p.split()
            o = next(i for i in range(len(ws)) if ws[i:i + len(k)] == k)
            at += [f"named_struct('w', {_str(w)}, 'o', {o + i})" for i, w in enumerate(k)]
        keys.append(_array(at, "struct<w:string,o:int>"))
        bans.append(_array([_str(w) for w in v.not_before], "string"))
    pairs = "array<struct<w:string,o:int>>"
    tables = {"rare": rare, "must": _array(keys, pairs), "bans": _array(bans, "array<string>"),
              "length": _array([str(len(ws)) for _, ws, _ in held], "int"), "label": _array([_str(x) for x, _, _ in held], "string")}
    if posts:
        proposed = f"flatten(transform(hits, h -> transform(coalesce(try_element_at({by_word}, h.w), array()), x -> named_struct('t', x.t, 'j', x.j, 'at', h.p - x.o))))"
        # judged once: for the first posting that holds at this start
        first = f"not exists(slice(get({tables['rare']}, x.t), 1, x.j), r -> get(words, x.at + r.o) <=> r.w)"
        share = f"aggregate(get({tables['rare']}, x.t), cast(0 as double), (a, r) -> a + if(get(words, x.at + r.o) <=> r.w, r.s, cast(0 as double)))"
        verified = (f"forall(get({tables['must']}, x.t), r -> get(words, x.at + r.o) <=> r.w) and "
                    f"not coalesce(array_contains(get({tables['bans']}, x.t), get(words, x.at + get({tables['length']}, x.t))), false)")
        places = (f"filter(transform(filter({proposed}, x -> {first} and {verified}), x -> named_struct('label', get({tables['label']}, x.t), "
                  f"'start', x.at, 'share', {share})), m -> m.share >= {min_share})")
    else:
        places = "cast(array() as array<struct<label:string,start:int,share:double>>)"
    base_places = "flatten(array(" + ", ".join(
        f"transform({_phrase_at('words', p)}, i -> named_struct('label', {_str(l)}, 'start', i))" for l, p in base.items()) + "))"
    return df.select(F.col("id").alias(id_col), F.size("words").cast("long").alias("n_words"),
                     F.expr(base_places).alias("base_places"), F.expr(places).alias("places"))


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns: counts, label lists and a score (1 for a base
    phrase, else the best share found)."""
    def joined(c: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.col("base_places")
    return scanned.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).cast("long").alias("first_word"),
        F.array_max(base["start"]).cast("long").alias("last_word"),
        joined(base["label"]).alias("base_labels"),
        joined(F.concat(base["label"], F.col("places")["label"])).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0))
        .otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max(F.col("places")["share"]), F.lit(0.0)))).alias("score"))
