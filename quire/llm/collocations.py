"""Phrase mining by dynamic itemset counting.

Phrases of one to ``MAX_WORDS`` words are counted in shards of the corpus that
are read in turn, over and over. A step counts phrases of all lengths at once:

- words from the first step on;
- a longer phrase from the step after both its parts (all words but the last,
  all but the first) have been seen ``threshold`` times, in whichever shard
  that happens;
- each phrase for one full cycle of steps, so that every shard counts once.

Steps end a cycle after the last phrase that reached the threshold, when every
phrase that could still matter has completed its cycle. Longer phrases so
start while shorter ones are still being counted, and the corpus is read in
fewer passes than there are lengths.

*What a task needs to know.* The step in which a part was found frequent comes
from a filter of ``2 ** 16`` to ``2 ** 26`` bytes (by the number of words),
which is broadcast: each slot holds the first step that set it. Slots may
collide, so a phrase may start too early, never too late, and since a slot
once set stays, it is still counted for one full cycle. Counts are therefore
exact, whatever the filter's load; a crowded filter only costs time.

*What is counted.* Texts are split once, into pieces of numbered words. A
phrase goes by 96 bits of hashes of its stratum and words, made for all places
of a piece at a time. A task adds up its pieces and sends each distinct phrase
once, with its count, to the bucket of its hash, as packed numbers; a bucket
adds up and keeps a step's counts. A phrase that reaches ``threshold`` within a cycle of
``SHARDS`` steps has ``threshold / SHARDS`` in one of them, so only phrases
with such a step are added up over steps, found again by a second filter of
the same size. A count keeps the number of a piece that it came from (its
*witness*); at the end each frequent phrase is sent to that one piece, which
gives it back its words.

Defined results: null and empty texts have no words; null strata are one
stratum of their own (``und``), together with rows that name it so; repeated
ids are counted row by row; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import from_payload, give_back, materialize, scratch_path, to_payload, worker_cache

SHARDS = 4
MAX_WORDS = 5
THRESHOLD = 100
TOP = 2000
#: A task forms a piece of each shard from about this much text.
PIECE_BYTES = 16 << 20
#: Words of one bucket and step, about.
BUCKET_WORDS = 1 << 20
UNNAMED = "und"
NEVER = 255
HASHES = 3
#: Counts that a task holds before it sends them, at most about.
HELD = 2_000_000
#: Bits of the two hashes that tell phrases apart.
_KEPT = np.array([[(1 << 64) - 1], [(1 << 32) - 1]], np.uint64)
#: Copies of a lookup row: many phrases start or end with the same word.
SALTS = 16
# one byte for one byte: A-Z to a-z, tabs to spaces, what ends a piece to \n
_SAME = bytes(range(256))
_TABLE = _SAME.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: pa.Array) -> np.ndarray:
    """Two 64-bit hashes of each word, ``(2, words)``: sums of random numbers
    drawn for every byte at every place."""
    kept = worker_cache()
    if "phrase bytes" not in kept:
        kept["phrase bytes"] = np.random.default_rng(13).integers(0, 1 << 64, (2, 64, 256), np.uint64, endpoint=False)
    table = kept["phrase bytes"]
    words = words.cast(pa.large_binary())
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    n = len(words)
    if not n:
        return np.zeros((2, 0), np.uint64)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + n + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0]:at[-1]]
    place = np.arange(len(data)) - np.repeat(at[:-1] - at[0], np.diff(at))
    with np.errstate(over="ignore"):
        turn = np.uint64(0x9E3779B97F4A7C15) ** (place // 64).astype(np.uint64)   # words of over 64 bytes
        return np.stack([_mix(np.add.reduceat(t[place % 64, data] * turn, at[:-1] - at[0])) for t in table])


def tokenised(docs: DataFrame, text_col: str, stratum_col: str, shards: int) -> DataFrame:
    """``(shard, piece, stratum, n_words, words, codes)``: some rows of one
    stratum as numbers and the words that they stand for (from 1); 0 ends a
    piece of text. ``piece`` numbers the rows, from 1; of very many tasks or
    strata some may share a number."""
    src = docs.select(F.coalesce(F.col(stratum_col).cast("string"), F.lit(UNNAMED)).alias("stratum"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[bytes]] = {}
        number = itertools.count(1 + (TaskContext.get().partitionId() << 12))
        size = dealt = 0
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                for stratum, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.setdefault((dealt % shards, stratum), []).append(text)
                    dealt += 1
                    size += len(text)
                    if size >= PIECE_BYTES:
                        yield from emit(held, number)
                        held, size = {}, 0
                        give_back()
        yield from emit(held, number)
        del held
        give_back()

    def emit(held: dict, number: Iterator[int]) -> Iterator[pa.RecordBatch]:
        for shard, stratum in list(held):
            words, codes = numbered(b"\n".join(held.pop((shard, stratum))))
            if len(words):
                n = int(np.count_nonzero(codes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([next(number) % ((1 << 31) - 1) or 1], pa.int32()),
                     pa.array([stratum], pa.string()), pa.array([n], pa.int64()),
                     pa.array([to_payload(pa.table({"w": words}))], pa.binary()),
                     pa.array([to_payload(pa.table({"c": codes}))], pa.binary())],
                    names=["shard", "piece", "stratum", "n_words", "words", "codes"])

    return src.mapInArrow(run, "shard int, piece int, stratum string, n_words long, words binary, codes binary")


def numbered(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of a text and their numbers in order, 0 between
    pieces and at both ends."""
    text = b"\n " + text.translate(_TABLE).replace(b"\n", b" \n ") + b" \n"
    whole = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(text)], np.int64)), pa.py_buffer(text))
    found = pc.split_pattern(whole, pattern=" ").flatten().dictionary_encode()
    word = ~np.isin(np.arange(len(found.dictionary)), [pc.index(found.dictionary, pa.scalar(x, found.dictionary.type)).as_py() for x in ("", "\n")])
    number = np.where(word, np.cumsum(word), 0).astype(np.int64)
    empty = pc.index(found.dictionary, pa.scalar("", found.dictionary.type)).as_py()
    at = found.indices.to_numpy()
    codes = number[at[at != empty]]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    return found.dictionary.filter(pa.array(word)), codes[keep].astype(np.uint32)


def slots(h: np.ndarray, size: int) -> np.ndarray:
    """The filter's slots of each hash, one row for each of ``HASHES``."""
    with np.errstate(over="ignore"):
        return np.stack([_mix(h + np.uint64(0x9E3779B97F4A7C15 * i & (1 << 64) - 1)) & np.uint64(size - 1)
                         for i in range(1, HASHES + 1)]).astype(np.int64)


def phrases_of(words: pa.Array, codes: np.ndarray, stratum: str, seen: np.ndarray, step: int,
               max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the places whose phrase counts in or before ``step``:
    ``(length, places, hashes (2, places), first step of each)``. For single
    words the places are numbers of words instead."""
    word = np.concatenate([np.zeros((2, 1), np.uint64), word_hashes(words)], axis=1)
    codes = codes.astype(np.int64)
    with np.errstate(over="ignore"):
        h = _mix(word ^ _mix(word_hashes(pa.array(["=" + stratum])))[:, :1])
        yield 1, np.arange(1, len(words) + 1), h[:, 1:], np.zeros(len(words), np.int16)
        at = np.flatnonzero(codes > 0)
        reached = _reached(seen, h[0])[codes[at]]
        first = np.zeros(len(at), np.int16)
        h = h[:, codes[at]]
        for k in range(2, max_words + 1):
            # one can't be found frequent before its own first step
            ok = reached < NEVER
            at, h, first = at[ok], h[:, ok], np.maximum(reached[ok], first[ok])
            # both parts, from this place and from the next, have been frequent
            pair = np.flatnonzero(at[1:] == at[:-1] + 1)
            first = np.maximum(first[pair], first[pair + 1]) + 1
            pair, first = pair[first <= step], first[first <= step]
            if not len(pair):
                return
            at = at[pair]
            h = _mix(h[:, pair] * np.uint64(0x9E3779B97F4A7C15) + word[:, codes[at + k - 1]])
            yield k, at, h, first
            if k < max_words:
                reached = _reached(seen, h[0])


def _reached(seen: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The step in which each phrase was found frequent, ``NEVER`` so far."""
    return seen[slots(h, len(seen))].max(axis=0).astype(np.int16)


def added_up(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(index, hashes, sums)`` of the distinct hashes ``(2, n)``."""
    order = np.argsort(h[0])
    s = h[:, order]
    new = np.ones(len(order), bool)
    new[1:] = s[0, 1:] != s[0, :-1]
    if ((s[1, 1:] != s[1, :-1]) & ~new[1:]).any():   # other phrases under one first hash
        order = np.lexsort((h[1], h[0]))
        s = h[:, order]
        new[1:] = (s[:, 1:] != s[:, :-1]).any(axis=0)
    starts = np.flatnonzero(new)
    return order[starts], s[:, starts], np.add.reduceat(n[order], starts) if len(starts) else n


def _piece(words: pa.Scalar, codes: pa.Scalar) -> tuple[pa.Array, np.ndarray]:
    return from_payload(words.as_buffer())["w"].combine_chunks(), from_payload(codes.as_buffer())["c"].to_numpy()


def _counted(h: np.ndarray, n: np.ndarray, k: np.ndarray, of: np.ndarray) -> bytes:
    """Counts sorted by hash, packed: the first hash byte by byte (neighbours
    share the high ones), 32 bits of the second; ``of``: their pieces."""
    planes = np.ascontiguousarray(h[0].astype(">u8").view(np.uint8).reshape(-1, 8).T)
    return to_payload(pa.table({c: pa.array([x.tobytes()], pa.large_binary()) for c, x in (
        ("h1", planes), ("h2", h[1].astype("<u4")), ("n", n.astype("<u4" if not len(n) or n.max() < 1 << 32 else "<u8")), ("k", k.astype(np.int8)),
        ("of", of.astype("<i4")))}))


def _counts_of(payload) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes (2, n), counts, lengths, pieces)`` of packed counts."""
    t = from_payload(payload)
    raw = {c: np.frombuffer(t[c][0].as_py(), np.uint8) for c in ("h1", "h2", "n", "k", "of")}
    size = len(raw["k"])
    first = np.ascontiguousarray(raw["h1"].reshape(8, size).T).view(">u8")[:, 0].astype(np.uint64)
    n = raw["n"].view("<u4" if len(raw["n"]) == 4 * size else "<u8").astype(np.int64)
    return np.stack([first, raw["h2"].view("<u4").astype(np.uint64)]), n, raw["k"].view(np.int8), raw["of"].view("<i4")


def step_counts(pieces: DataFrame, seen, step: int, shards: int, max_words: int, buckets: int, some: int) -> DataFrame:
    """``(bucket, counts, heavy)``: the counts of one shard's pieces in
    ``step``, and of those the ones of ``some`` or more. Only these keep their
    witness."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(seen.value, np.uint8)
        found: list[tuple] = []
        size = 0
        for b in batches:
            for piece, stratum, w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                words, codes = _piece(w, c)
                for k, _, h, first in phrases_of(words, codes, stratum, table, step, max_words):
                    due = first + shards > step
                    if due.any():
                        d, n = h[:, due], np.ones(int(due.sum()), np.int64)
                        if k == 1:
                            n = np.bincount(codes, minlength=len(words) + 1)[1:][due]
                        else:
                            _, d, n = added_up(d, n)
                        found.append((d & _KEPT, n, np.full(len(n), k, np.int8), np.full(len(n), piece, np.int32)))
                        size += len(n)
                # pieces of a task are added up before they are sent
                if size >= HELD:
                    found = [together(found)]
                    size = len(found[0][1])
                    if size >= HELD // 2:
                        yield packed(*found[0])
                        found, size = [], 0
                        give_back()
        if found:
            yield packed(*together(found))
        found.clear()
        give_back()

    def together(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h, n, k, of = (np.concatenate(x, axis=-1) for x in zip(*found))
        at, h, n = added_up(h, n)
        return h, n, k[at], of[at]

    def packed(h: np.ndarray, n: np.ndarray, k: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        # buckets are stretches of the first hash, which is sorted
        bucket = ((h[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        parts = [(i, slice(lo, hi)) for i, (lo, hi) in enumerate(zip(cut, cut[1:])) if hi > lo]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()),
                                           pa.array([_counted(h[:, x], n[x], k[x], of[x]) for _, x in parts], pa.binary())], names=["bucket", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        h, n, k, of = together([_counts_of(p) for p in pdf["counts"]])
        big = n >= some
        of[~big] = 0
        give_back()
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "counts": [_counted(h, n, k, of)],
                             "heavy": [_counted(h[:, big], n[big], k[big], of[big])]})

    sent = pieces.select("piece", "stratum", "words", "codes").mapInArrow(count, "bucket int, counts binary")
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(add, "bucket int, counts binary, heavy binary")


def _slots_of(rows: DataFrame, size: int) -> np.ndarray:
    """The distinct slots of the first hashes in ``rows`` (packed counts, or a
    column of hashes), at most ``size``: what the driver gathers."""
    packed = rows.schema[0].dataType.typeName() == "binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.int64)
        for b in batches:
            hashes = [_counts_of(p.as_buffer())[0][0] for p in b.column(0)] if packed else [b.column(0).to_numpy().view(np.uint64)]
            for h in hashes:
                mine = np.union1d(mine, slots(h, size).ravel())
        if len(mine):
            yield pa.RecordBatch.from_arrays([pa.array(mine)], names=["slot"])

    return rows.mapInArrow(local, "slot long").distinct().toArrow()["slot"].to_numpy()


def _matching(steps: list[DataFrame], heavy: np.ndarray, now: int) -> DataFrame:
    """``(h1, h2, k, n, now, piece)`` of the phrases of some steps with a heavy
    one; ``piece`` is one of their witnesses, dealt by a hash."""
    sent = steps[0].sparkSession.sparkContext.broadcast(heavy.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, bool)
        for b in batches:
            for payload, step in zip(b.column(0), b.column(1).to_pylist()):
                h, n, k, of = _counts_of(payload.as_buffer())
                at = np.flatnonzero(bits[slots(h[0], len(bits))].all(axis=0))
                if len(at):
                    n = n[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[0, at].view(np.int64)), pa.array(h[1, at].view(np.int64)), pa.array(k[at].astype(np.int32)),
                         pa.array(n), pa.array(n if step == now else np.zeros_like(n)), pa.array(of[at])],
                        names=["h1", "h2", "k", "n", "now", "piece"])
        give_back()

    every = steps[0].select("counts", "step")
    for s in steps[1:]:
        every = every.unionByName(s.select("counts", "step"))
    got = every.mapInArrow(run, "h1 long, h2 long, k int, n long, now long, piece int")
    dealt = F.when(F.col("piece") > 0, F.xxhash64("piece", "h1"))
    return got.groupBy("h1", "h2").agg(F.first("k").alias("k"), F.sum("n").alias("n"), F.sum("now").alias("now"),
                                       F.max_by("piece", dealt).alias("piece"))


def _named(pieces: DataFrame, frequent: DataFrame, seen, step: int, max_words: int, parts: int) -> DataFrame:
    """``(stratum, phrase, k, n)`` of the ``frequent`` phrases: each is looked
    up in its witness only."""
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        # of equal first hashes the second decides
        asked = asked.sort_by([("h1", "ascending"), ("h2", "ascending")]) if len(asked) else asked
        first, second = (asked[c].to_numpy() for c in ("h1", "h2"))
        most = int(np.unique(first, return_counts=True)[1].max()) if len(asked) and len(held) else 0
        todo = np.ones(len(first), bool)
        out = []
        for stratum, w, c in zip(held["stratum"].to_pylist(), held["words"], held["codes"]) if most else ():
            words, codes = _piece(w, c)
            for k, place, h, _ in phrases_of(words, codes, stratum, np.frombuffer(seen.value, np.uint8), step, max_words):
                h = (h & _KEPT).view(np.int64)
                low = np.searchsorted(first, h[0])
                for i in range(most):
                    at = np.minimum(low + i, len(first) - 1)
                    here = np.flatnonzero((first[at] == h[0]) & (second[at] == h[1]) & todo[at])
                    row, one = np.unique(at[here], return_index=True)
                    if not len(row):
                        continue
                    todo[row] = False
                    one = place[here[one]]
                    text = [words.take(pa.array((one if k == 1 else codes[one + j].astype(np.int64)) - 1)) for j in range(k)]
                    text = pc.binary_join_element_wise(*text, pa.scalar(" ", text[0].type)) if k > 1 else text[0]
                    out.append(pa.table({"stratum": pa.array([stratum] * len(row), pa.string()), "phrase": text.cast(pa.string()),
                                         "k": asked["k"].take(pa.array(row)), "n": asked["n"].take(pa.array(row))}))
        if todo.any():
            raise RuntimeError(f"{int(todo.sum())} frequent phrases are not in their piece")
        give_back()
        return pa.concat_tables(out) if out else empty

    empty = pa.schema([("stratum", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64())]).empty_table()
    held, asked = (x.repartition(parts, "piece").groupBy("piece") for x in (
        pieces.select("piece", "stratum", "words", "codes"), frequent.select("piece", "h1", "h2", "k", "n")))
    return held.cogroup(asked).applyInArrow(run, "stratum string, phrase string, k int, n long")


def phrase_counts(docs: DataFrame, text_col: str = "text", stratum_col: str = "lang", threshold: int = THRESHOLD,
                  max_words: int = MAX_WORDS, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """``(counts, totals)``: ``(stratum, phrase, k, n)`` of every phrase of
    one to ``max_words`` words with ``threshold`` occurrences, and ``(stratum,
    n)`` for the words of each stratum."""
    spark = docs.sparkSession
    path = scratch_path(spark, "phrase-pieces")
    tokenised(docs, text_col, stratum_col, shards).write.partitionBy("shard").option("compression", "none").parquet(path)
    pieces = spark.read.schema("piece int, stratum string, n_words long, words binary, codes binary, shard int").parquet(path)
    totals = pieces.groupBy("stratum").agg(F.sum("n_words").alias("n"))
    n_words = pieces.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    size = 1 << min(26, max(16, (n_words // 32).bit_length()))
    buckets = max(n_words // (shards * BUCKET_WORDS), min(2 * spark.sparkContext.defaultParallelism, n_words >> 16), 1)
    seen = np.full(size, NEVER, np.uint8)
    some = -(-threshold // shards)
    steps: list[DataFrame] = []
    heavy: list[np.ndarray] = []
    step, last = 0, -1
    while n_words and step < max(shards, last + 1 + shards):
        if step >= NEVER:
            raise ValueError(f"{shards} shards and {max_words} words take more than {NEVER} steps")
        sent = spark.sparkContext.broadcast(seen.tobytes())
        of_shard = pieces.filter(F.col("shard") == step % shards)
        steps.append(materialize(step_counts(of_shard, sent, step, shards, max_words, buckets, some)
                                 .withColumn("step", F.lit(step)), "phrase-step"))
        sent.unpersist()
        heavy.append(_slots_of(steps[-1].select("heavy"), size))
        # phrases that reached the threshold in this step
        fresh = (_matching(steps[-shards:], _bits(heavy[-shards:], size), step)
                 .filter((F.col("k") < max_words) & (F.col("n") >= threshold) & (F.col("n") - F.col("now") < threshold)))
        new = _slots_of(fresh.select("h1"), size)
        if len(new):
            last = step
            seen[new[seen[new] == NEVER]] = step
        step += 1
    if not steps:
        return spark.createDataFrame([], "stratum string, phrase string, k int, n long"), totals
    frequent = _matching(steps, _bits(heavy, size), -1).filter(F.col("n") >= threshold)
    parts = max(1, n_words // BUCKET_WORDS, min(2 * spark.sparkContext.defaultParallelism, n_words >> 16))
    names = _named(pieces, frequent, spark.sparkContext.broadcast(seen.tobytes()), step, max_words, parts)
    return materialize(names, "phrases"), totals


def _bits(parts: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    for p in parts:
        out[p] = True
    return out


def collocations(docs: DataFrame, text_col: str = "text", stratum_col: str = "lang", threshold: int = THRESHOLD,
                 max_words: int = MAX_WORDS, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """The ``top`` phrases of two and more words of each stratum: ``(stratum,
    rank, phrase, a, l, r, n, score)``. The score is that of the phrase's
    weakest cut into two parts; phrases that never stand outside a longer one
    are left out."""
    counts, totals = phrase_counts(docs, text_col, stratum_col, threshold, max_words, shards)
    words = F.split("phrase", " ")
    found = counts.filter("k > 1").select("stratum", "phrase", "k", F.col("n").alias("a"))
    # a phrase that some phrase one word longer holds as often is left out
    # (with an even longer one as frequent, the one between is as frequent, too)
    inner = found.filter("k > 2").select("stratum", "a", F.explode(F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "),
        F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    longest = inner.groupBy("stratum", "phrase").agg(F.max("a").alias("longer"))
    free = (found.join(longest, ["stratum", "phrase"], "left")
            .filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer"))
    cuts = (free.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .withColumn("head", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " "))
            .withColumn("tail", F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " "))
            .withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))))
    known = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))) \
        .select("stratum", "phrase", F.col("salt").cast("long").alias("salt"), "n")
    heads = known.select("stratum", "salt", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = known.select("stratum", "salt", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    scored = cuts.join(heads, ["stratum", "salt", "head"]).join(tails, ["stratum", "salt", "tail"]).join(totals, "stratum")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumn("top", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")) \
        .withColumn("below", exact("l") * exact("r")).withColumn("score", F.expr("`top` div below"))
    least = scored.groupBy("stratum", "phrase").agg(
        F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s")).select("stratum", "phrase", "s.*")
    order = Window.partitionBy("stratum").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (least.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
            .select("stratum", "rank", "phrase", "a", "l", "r", "n", "score"))
