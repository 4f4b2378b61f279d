"""N-gram Jaccard join by grouped prefixes, and its connected classes.

A document is the set of its distinct word shingles. Documents with equal sets
form a *class* represented by its smallest id. Shingles are ordered from rare
to frequent: a table of ``SLOTS`` counters, filled from all documents, ranks
them (any fixed order gives the same links; a rare-first order gives few
candidates). Two sets of similarity ``t`` must share a shingle among the first
``n - ceil(t n) + 1`` of each, their prefixes.

Classes with the same size and prefix collapse into one *group*. Group pairs
come from the posting lists of prefix shingles and must pass the size and
position filters; they are expanded to members and verified on whole sets. As
the result is connectivity, this happens twice. First every group of a posting
list meets only the heads of its own band of sizes and of the band below (the
groups with the fewest rarer shingles), and every member its group's leader. Then only what is not yet connected is compared:
lists that lie in one component are dropped, and the remaining pairs of
different components are expanded and verified in full. A list of many near
copies thus costs its length, not its square, and no link that joins two
components is missed.

Defined results: null or empty texts and texts without words have an empty set
and are their own component, as are rows with a null id (component null);
a text with fewer words than a shingle has its word sequence as only element;
rows that repeat an id are kept row by row (they should repeat its text; else
one of the id's texts stands for it in the comparison); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import give_back, materialize
from quire.llm.components import components

WORDS = 4
#: Similarity as a fraction in hundredths, compared in whole numbers.
PERCENT = 85
SLOTS = 1 << 20
#: Size of the table of ids to verify.
BITS = 1 << 24
_FAN = 64
_SEGMENT = 1 << 14
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[str | None], size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    known: dict[bytes, int] = {}
    flat: list[int] = []
    ends = []
    for t in texts:
        for w in (t or "").encode().translate(_LOWER).split():
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            flat.append(h)
        ends.append(len(flat))
    words = np.array(flat, np.uint64)
    with np.errstate(over="ignore"):
        roll = np.zeros(len(words), np.uint64)
        if len(words) >= size:
            h = words[:len(words) - size + 1].copy()
            for i in range(1, size):
                h = h * _MUL + words[i:len(words) - size + 1 + i]
            roll[:len(h)] = _mix(h)
        out, lo = [], 0
        for hi in ends:
            n = hi - lo
            if n >= size:
                out.append(np.unique(roll[lo:hi - size + 1]))
            elif n:
                h = np.uint64(n)
                for w in words[lo:hi]:
                    h = h * _MUL + w
                out.append(_mix(np.array([h], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            lo = hi
    return out


def slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h & np.uint64(slots - 1)).astype(np.int64)


def _small(batches: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    """Batches cut small: a text's words weigh several times the text."""
    for pdf in batches:
        for lo in range(0, len(pdf), rows):
            yield pdf.iloc[lo:lo + rows]
    give_back()


def frequencies(docs: DataFrame, size: int = WORDS, slots: int = SLOTS) -> np.ndarray:
    """Counters of all documents' shingles by hash slot: a table of fixed
    size, summed segment by segment, each in a tree: a group adds those of
    ``_FAN`` tasks, then of ``_FAN`` such groups, and so on."""
    n_seg = max(1, slots // _SEGMENT)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(slots, np.int64)
        for pdf in _small(batches):
            got = shingles(pdf["text"].tolist(), size)
            if got:
                total += np.bincount(slot(np.concatenate(got), slots), minlength=slots)
        if total.any():
            kind = "<i4" if total.max() < 1 << 31 else "<i8"
            parts = np.array_split(total, n_seg)
            yield pd.DataFrame({"segment": range(n_seg), "width": int(kind[-1]), "counts": [p.astype(kind).tobytes() for p in parts]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, f"<i{w}").astype(np.int64) for c, w in zip(pdf["counts"], pdf["width"]))
        give_back()
        return pd.DataFrame({"segment": [key[0]], "node": [key[1]], "width": [8], "counts": [total.astype("<i8").tobytes()]})

    shape = "segment int, node int, width int, counts binary"
    sums = (docs.mapInPandas(count, "segment int, width int, counts binary")
            .withColumn("node", F.floor(F.spark_partition_id() / _FAN).cast("int")).groupBy("segment", "node").applyInPandas(add, shape))
    for _ in range(2):   # 64 ** 3 tasks come down to a sum each of 64 ** 0
        sums = sums.withColumn("node", F.floor(F.col("node") / _FAN).cast("int")).groupBy("segment", "node").applyInPandas(add, shape)
    rows = sums.groupBy("segment").agg(F.collect_list("counts").alias("all")).collect()  # SLOTS counters
    rows = [{"segment": r["segment"], "counts": sum(np.frombuffer(c, "<i8") for c in r["all"]).tobytes()} for r in rows]
    parts = {r["segment"]: np.frombuffer(r["counts"], "<i8") for r in rows}
    empty = [len(p) for p in np.array_split(np.zeros(slots, np.int8), n_seg)]
    return np.concatenate([parts.get(i, np.zeros(empty[i], np.int64)) for i in range(n_seg)])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def sketch(docs: DataFrame, freq: np.ndarray, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(id, n, whole, prefix, tokens)``: set size, hash of the set, hash of
    size and prefix, and the prefix from rare to frequent."""
    ranked = np.argsort(np.argsort(freq, kind="stable"), kind="stable").astype(np.int32) if len(freq) else freq
    shared = docs.sparkSession.sparkContext.broadcast(ranked)  # SLOTS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = shared.value
        for pdf in _small(batches):
            rows = []
            for i, h in zip(pdf["id"], shingles(pdf["text"].tolist(), size)):
                n = len(h)
                if n:
                    h = h[np.lexsort((h, rank[slot(h, len(rank))]))]
                    p = h[:prefix_length(n, percent)]
                    rows.append((i, n, xxhash.xxh128_digest(np.sort(h).tobytes()),
                                 xxhash.xxh128_digest(np.append(p, np.uint64(n)).tobytes()), p.view(np.int64)))
                else:
                    rows.append((i, 0, None, None, np.zeros(0, np.int64)))
            yield pd.DataFrame(rows, columns=["id", "n", "whole", "prefix", "tokens"])

    return docs.mapInPandas(run, "id long, n int, whole binary, prefix binary, tokens array<long>")


def long_enough(percent: int):
    """Size filter on ``n`` and ``n2``, and the position filter of a shared
    prefix shingle at ``p`` and ``p2`` (from 0)."""
    size = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
    # what two different sets can still share from here on, the prefixes
    # before it being disjoint at a pair's first shared shingle
    most = "least(n - p, n2 - p2, n - if(n = n2, 1, 0))"
    return f"{size} and {100 + percent} * {most} >= {percent} * (n + n2)"


def same_size(percent: int):
    """Whether different sets of one size ``n`` can be similar at all."""
    return f"{100 + percent} * (n - 1) >= {2 * percent} * n"


def asked_for(docs: DataFrame, ids: DataFrame, bits: int = BITS) -> DataFrame:
    """``(id, text)`` of all ``ids`` and of few others: a broadcast table of at
    most ``bits`` bits keeps the texts that are in no pair out of the shuffle
    by id."""
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    table = (ids.select(F.shiftright(bit, 6).alias("word"), F.pmod(bit, F.lit(64)).cast("int").alias("at")).groupBy("word")
             .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("set")))
    return (docs.withColumn("word", F.shiftright(bit, 6)).join(F.broadcast(table), "word")
            .filter(F.getbit("set", F.pmod(bit, F.lit(64)).cast("int")) == 1).select("id", "text"))


def verify(pairs: DataFrame, docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _small(batches):
            yield pd.DataFrame({"id": pdf["id"], "s": [h.tobytes() for h in shingles(pdf["text"].tolist(), size)]})

    # of texts with one id the least, on every retry; ids are distinct, and a
    # semi join would be moved below the table of bits
    held = asked_for(docs, ids).join(ids, "id").groupBy("id").agg(F.min("text").alias("text")).mapInPandas(sets, "id long, s binary")
    j = (pairs.join(held.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
         .join(held.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["sa"], pdf["sb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]
        give_back()

    return j.select("a", "b", "sa", "sb").mapInPandas(check, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
                 percent: int = PERCENT, slots: int = SLOTS) -> DataFrame:
    """``(<id_col>, n_shingles, component_id)`` of every row."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = materialize(sketch(src, frequencies(src.select("text"), size, slots), size, percent), "jaccard-sketch")
    able = marked.filter("n > 0 and id is not null")

    # classes of equal sets, groups of equal size and prefix
    classes = able.groupBy("whole").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = materialize(classes, "jaccard-classes")
    members = materialize(classes.join(classes.groupBy("prefix").agg(F.min("id").alias("g")), "prefix")
                          .select("g", "id", "n"), "jaccard-groups")
    leaders = members.filter("g = id").select("id")
    posts = (able.join(leaders, "id", "left_semi").dropDuplicates(["id"])
             .select(F.col("id").alias("g"), "n", F.posexplode("tokens").alias("p", "token")))
    # shingles of one group only link nothing
    common = posts.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token")
    posts = materialize(posts.join(common, "token"), "jaccard-postings")

    # first pass: each group against the heads of its list, in its own band of
    # sizes and in the next smaller one. A head has the fewest rarer shingles
    # before the shared one: it is the least edited of near copies
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent))).cast("int")
    posts_b = posts.withColumn("band", band)
    heads = (posts_b.groupBy("token", "band").agg(F.min(F.struct("p", "n", "g")).alias("h"))
             .withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))))
    star = posts_b.join(heads, ["token", "band"]).select(
        "g", "n", "p", F.col("h.g").alias("g2"), F.col("h.n").alias("n2"), F.col("h.p").alias("p2"))
    first = (star.filter("g != g2").filter(long_enough(percent))
             .select(F.least("g", "g2").alias("a"), F.greatest("g", "g2").alias("b"))
             .unionByName(members.filter("g != id").filter(same_size(percent)).select(F.col("g").alias("a"), F.col("id").alias("b"))).distinct())
    first = materialize(first, "jaccard-pairs")   # read three times below
    linked = materialize(verify(first, src, size, percent), "jaccard-links")
    comp = components(linked)

    # second pass: only what lies in different components
    placed = materialize(members.join(comp.withColumnRenamed("node", "id"), "id", "left")
                         .select("g", "id", "n", F.coalesce("component", "id").alias("c")), "jaccard-placed")
    spans = placed.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.first("n").alias("n"))
    open_posts = posts.join(spans.drop("n"), "g")
    split = (open_posts.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l != h").select("token"))
    left = open_posts.join(split, "token")
    right = left.select("token", *[F.col(c).alias(c + "2") for c in ("g", "n", "p", "lo", "hi")])
    groups = (left.join(right, "token").filter("g < g2 and not (lo = hi and lo2 = hi2 and lo = lo2)").filter(long_enough(percent))
              .select("g", "g2").distinct()
              .unionByName(spans.filter("lo != hi").filter(same_size(percent)).select("g", F.col("g").alias("g2"))))
    second = (groups.join(placed.select("g", F.col("id").alias("a"), "c"), "g")
              .join(placed.select(F.col("g").alias("g2"), F.col("id").alias("b"), F.col("c").alias("c2")), "g2")
              .filter("c != c2 and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    second = materialize(second.join(first, ["a", "b"], "left_anti"), "jaccard-pairs")
    more = materialize(verify(second, src, size, percent), "jaccard-links")
    # the components found so far are stars already
    final = comp if more.isEmpty() else components(
        more.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    # back to all rows: row -> class -> component
    placed_class = (classes.join(final.withColumnRenamed("node", "id"), "id", "left")
                    .select("whole", F.coalesce("component", "id").alias("component")))
    return (marked.select("id", "n", "whole").join(placed_class, "whole", "left")
            .select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")))
