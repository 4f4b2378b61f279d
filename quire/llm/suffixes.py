"""Exact removal of repeated byte strings by bucket-pointer refinement.

A byte goes when it lies in a string of ``length`` bytes that also starts in a
document with a smaller id. Equal strings are found as in suffix sorting by
bucket-pointer refinement: suffixes start in buckets of a short q-gram, and a
bucket is refined by sorting on the bucket identifiers that its members have
at later offsets, identifiers already refined being used again at the next
level. Only suffixes that can share a string are sorted:

1. Every string of ``length`` bytes is represented by its *anchor*, the
   ``Q``-gram in it with the least hash (leftmost of equals), so equal strings
   have equal anchors at equal offsets. Documents are dealt into blocks; a
   block sends its distinct anchors to the bucket of their hash.
2. A bucket tells each block which of its anchors stand in several documents.
3. For those a block sends the *context*: the bytes of all strings that have
   this anchor (at most ``2 * length - Q``). Equal contexts of a block are sent
   once, with their smallest document.
4. A bucket collapses equal contexts and refines the strings of the others:
   8-grams, then 16, 32 and ``length`` bytes by pairs of bucket identifiers.
   A string is repeated when its final bucket holds a smaller document.
5. Blocks read the answers off in the order in which they asked.

Exact copies of a whole text are settled beforehand by a digest: only the one
with the smallest id takes part. An anchor in more than ``HOT`` documents is
sent string by string, each to the bucket of its own bytes, so that its
contexts don't meet in one task; equal strings still go once per block.

Defined results: null or empty texts lose nothing, nor do texts shorter than
``length``; rows with a null id neither lose nor remove anything; rows that
repeat an id don't remove each other's bytes; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import block_count, block_of, from_payload, give_back, pack_blocks, to_payload, unpack

LENGTH = 50
Q = 24
HOT = 2000
KEY_BITS = 48
#: Contexts that are refined at a time (more where one anchor has more).
PART = 4000
#: Contexts whose bytes are held at a time.
ROWS = 20_000
#: Smaller blocks than elsewhere: a task holds several numbers for each byte.
BLOCK_BYTES = 8 << 20
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


def _hash_rows(rows: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of bytes (width a multiple of 8)."""
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.full(len(rows), seed, np.uint64)
    for i in range(words.shape[1]):
        h = _mix(h ^ words[:, i]) + np.uint64(0x9E3779B97F4A7C15)
    return h


def gram_hash(data: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit hash of the ``q`` bytes from each position, by doubling."""
    mul = np.uint32(0x01000193)
    level, width = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1), 1
    out, done = None, 0
    while True:
        if q & width:
            if out is None:
                out, done = level, width
            else:  # the wider, later part in front
                n = len(data) - done - width + 1
                out, done = level[:n] * np.uint32(pow(int(mul), done, 1 << 32)) + out[width:width + n], done + width
        if 2 * width > q:
            break
        n = len(data) - 2 * width + 1
        level = level[:n] * np.uint32(pow(int(mul), width, 1 << 32)) + level[width:width + n]
        width *= 2
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    out = (out ^ (out >> np.uint32(12))) * np.uint32(0x297A2D39)
    return out ^ (out >> np.uint32(15))


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of each ``w`` values (leftmost of equals)."""
    z = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= w:
        z = np.minimum(z[:-width], z[width:])
        width *= 2
    if width < w:
        z = np.minimum(z[:len(z) - (w - width)], z[w - width:])
    return (z & np.uint64(0xFFFFFFFF)).astype(np.int64)


def gather(data: np.ndarray, at: np.ndarray, n: int, width: int) -> np.ndarray:
    """The ``n`` bytes from each position as rows of ``width`` (in parts: an
    index weighs eight times the bytes)."""
    out = np.zeros((len(at), width), np.uint8)
    for lo in range(0, len(at), 20_000):
        out[lo:lo + 20_000, :n] = data[at[lo:lo + 20_000, None] + np.arange(n)]
    return out


class Block:
    """The texts of a block that take part, and their anchors."""

    def __init__(self, table: pa.Table | None, firsts: set[str], length: int, q: int):
        self.length, self.q = length, q
        self.width = -(-(2 * length - q) // 8) * 8
        rows = [] if table is None else list(zip(table["id"].to_pylist(), table["text"].to_pylist()))
        self.rows = [(i, (t or "").encode()) for i, t in rows]
        used = [k for k, (i, t) in enumerate(self.rows) if i is not None and len(t) >= length and i in firsts]
        self.start = np.zeros(len(used) + 1, np.int64)
        self.used = used
        self.ids = np.array([int(self.rows[k][0]) for k in used], np.int64)
        self.start[1:] = np.cumsum([len(self.rows[k][1]) for k in used])
        buf = b"".join([self.rows[k][1] for k in used])
        self.data = np.frombuffer(buf + b"\0" * self.width, np.uint8)
        first, last, anchor, doc = [], [], [], []
        with np.errstate(over="ignore"):
            for j in range(len(used)):
                lo, hi = self.start[j], self.start[j + 1]
                pos = sliding_least(gram_hash(self.data[lo:hi], q), length - q + 1)
                cut = np.flatnonzero(pos[1:] != pos[:-1]) + 1
                s = np.concatenate([[0], cut])
                first.append(s + lo)
                last.append(np.concatenate([cut - 1, [len(pos) - 1]]) + lo)
                anchor.append(pos[s] + lo)
                doc.append(np.full(len(s), j, np.int32))
            cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            #: first and last start of the strings of each anchor, its own start, its document
            self.first, self.last, self.anchor, self.doc = cat(first, np.int64), cat(last, np.int64), cat(anchor, np.int64), cat(doc, np.int32)
            del first, last, anchor, doc
            self.key = np.empty(len(self.anchor), np.uint64)
            for at in range(0, len(self.anchor), 50_000):
                grams = gather(self.data, self.anchor[at:at + 50_000], q, -(-q // 8) * 8)
                self.key[at:at + 50_000] = _hash_rows(grams, 1) >> np.uint64(64 - KEY_BITS)
        # an anchor of a document counts once: numbered by key, then document
        self.keys, of = np.unique(self.key, return_inverse=True)
        pair = np.unique(of * max(1, len(used)) + self.doc)
        #: distinct anchors and in how many of the block's documents they are
        n = np.bincount(pair // max(1, len(used)), minlength=len(self.keys))
        self.docs_of = np.minimum(n, 65_535).astype(np.uint16)

    def contexts(self, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """Contexts of the anchors whose ``state`` (by distinct anchor) is 1,
        and single strings for state 2: ``(first, last, anchor - first, doc,
        key)``."""
        s = state[np.searchsorted(self.keys, self.key)] if len(self.keys) else np.zeros(0, np.uint8)
        one = np.flatnonzero(s == 1)
        many = np.flatnonzero(s == 2)
        n = self.last[many] - self.first[many] + 1
        which = np.repeat(many, n)
        at = self.first[which] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hot_key = np.empty(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for lo in range(0, len(at), ROWS):
                strings = gather(self.data, at[lo:lo + ROWS], self.length, -(-self.length // 8) * 8)
                hot_key[lo:lo + ROWS] = _hash_rows(strings, 2) >> np.uint64(64 - KEY_BITS)
        return (np.concatenate([self.first[one], at]), np.concatenate([self.last[one], at]),
                np.concatenate([self.anchor[one] - self.first[one], np.full(len(at), 255)]),
                np.concatenate([self.doc[one], self.doc[which]]), np.concatenate([self.key[one], hot_key]))

    def bytes_of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Context bytes as rows of equal width, zero behind the end."""
        rows = gather(self.data, first, self.width, self.width)
        rows[np.arange(self.width) >= (last - first + self.length)[:, None]] = 0
        return np.ascontiguousarray(rows)

    def asked(self, state: np.ndarray, n: int) -> "Asked":
        return Asked(self, state, n)


class Asked:
    """A block's distinct contexts in the order in which it asks."""

    def __init__(self, block: Block, state: np.ndarray, n: int):
        self.first, self.last, off, doc, key = block.contexts(state)
        self.ids = block.ids[doc] if len(doc) else np.zeros(0, np.int64)
        self.block = block
        size = (self.last - self.first + 1).astype(np.uint64)
        h1, h2 = np.empty(len(key), np.uint64), np.empty(len(key), np.uint64)
        with np.errstate(over="ignore"):
            for lo in range(0, len(key), ROWS):  # bytes are looked at in parts, and kept by none
                at = slice(lo, lo + ROWS)
                rows = block.bytes_of(self.first[at], self.last[at])
                seed = _mix(key[at] ^ (size[at] << np.uint64(48)) ^ (off[at].astype(np.uint64) << np.uint64(56)))
                h1[at], h2[at] = _mix(_hash_rows(rows, 3) ^ seed), _mix(_hash_rows(rows, 4) + seed)
        bucket = (key % np.uint64(n)).astype(np.int64)
        order = np.lexsort((self.ids, h2, h1, bucket))
        new = np.ones(len(order), bool)
        o1, o2, ob = h1[order], h2[order], bucket[order]
        new[1:] = (o1[1:] != o1[:-1]) | (o2[1:] != o2[:-1]) | (ob[1:] != ob[:-1])
        #: for each context its distinct context; for those their first (smallest document)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.rep = order[new]
        self.bucket = ob[new]
        self.size, self.off, self.key = size[self.rep].astype(np.uint8), off[self.rep].astype(np.uint8), key[self.rep]

    def requests(self) -> Iterator[tuple[int, bytes]]:
        for b in np.unique(self.bucket):
            at = np.flatnonzero(self.bucket == b)
            rows = self.block.bytes_of(self.first[self.rep[at]], self.last[self.rep[at]])
            yield int(b), to_payload(pa.table({
                "id": self.ids[self.rep[at]], "key": self.key[at], "size": self.size[at], "off": self.off[at],
                "row": pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(at), [None, pa.py_buffer(rows)])}))


def pack_keys(keys: np.ndarray, docs_of: np.ndarray) -> bytes:
    """Sorted anchors as planes of bytes, which compress well."""
    planes = keys.astype("<u8").view(np.uint8).reshape(len(keys), 8)[:, :KEY_BITS // 8]
    return to_payload(pa.table({"k": pa.array([np.ascontiguousarray(planes.T).tobytes()], pa.large_binary()),
                                "d": pa.array([docs_of.astype("<u2").tobytes()], pa.large_binary())}))


def unpack_keys(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    t = from_payload(payload)
    docs_of = np.frombuffer(t["d"][0].as_py(), "<u2")
    planes = np.zeros((len(docs_of), 8), np.uint8)
    planes[:, :KEY_BITS // 8] = np.frombuffer(t["k"][0].as_py(), np.uint8).reshape(KEY_BITS // 8, len(docs_of)).T
    return planes.view("<u8")[:, 0], docs_of


def judge_anchors(payloads: list[bytes], hot: int) -> list[np.ndarray]:
    """State of each asked anchor: 0 in one document only, 1 in several, 2 in
    more than ``hot``."""
    lists = [unpack_keys(p) for p in payloads]
    keys = np.concatenate([k for k, _ in lists])
    uniq, inv = np.unique(keys, return_inverse=True)
    total = np.bincount(inv, weights=np.concatenate([d for _, d in lists]).astype(float), minlength=len(uniq))
    state = ((total > 1).astype(np.uint8) + (total > hot))[inv]
    return np.split(state, np.cumsum([len(k) for k, _ in lists])[:-1])


def refine(rows: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket identifiers of the strings of each context: ``(context, offset,
    bucket)``. Bytes are compared exactly: 8-grams are numbered, and wider
    grams are numbered by the pair of identifiers at two offsets."""
    n, width = rows.shape
    have = size.astype(np.int64) + length - 1
    flat = np.lib.stride_tricks.as_strided(rows.ravel().view(np.uint8), (n * width - 7, 8), (1, 1))
    grams = np.ascontiguousarray(flat).view("<u8")[:, 0]
    ids = np.zeros(n * width, np.int64)
    col = np.tile(np.arange(width), n)
    until = np.repeat(have, width)
    live = np.flatnonzero(col + 8 <= until)
    ids[live] = np.unique(grams[live], return_inverse=True)[1]
    reach = 8
    while reach < length:
        step = min(reach, length - reach)
        live = live[col[live] + reach + step <= until[live]]
        pair = ids[live] * (int(ids.max()) + 1) + ids[live + step]
        ids[live] = np.unique(pair, return_inverse=True)[1]
        reach += step
    return live // width, col[live], ids[live]


def judge_contexts(payloads: list[bytes], length: int) -> list[np.ndarray]:
    """For each asked context a bit per string: set when the string also
    starts in a smaller document."""
    tables = [from_payload(p) for p in payloads]
    t = pa.concat_tables(tables).combine_chunks()
    ids, key, size, off = (t[c].to_numpy() for c in ("id", "key", "size", "off"))
    row = t["row"].combine_chunks() if isinstance(t["row"], pa.ChunkedArray) else t["row"]
    row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
    width = row.type.byte_width
    rows = np.frombuffer(row.buffers()[1], np.uint8)[row.offset * width:(row.offset + len(row)) * width].reshape(len(row), width)
    # equal contexts: sorted by their bytes' hash, equality checked on bytes
    with np.errstate(over="ignore"):
        h = _hash_rows(rows, 5) ^ _mix(key ^ (size.astype(np.uint64) << np.uint64(48)) ^ (off.astype(np.uint64) << np.uint64(56)))
    order = np.lexsort((ids, size, off, key, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (size[order][1:] != size[order][:-1]) | (rows[order][1:] != rows[order][:-1]).any(axis=1)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    rep = order[new]
    full = ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    bits = np.zeros(len(rep), np.uint32)
    # only an anchor with several contexts needs refinement
    _, of_key, n = np.unique(key[rep], return_inverse=True, return_counts=True)
    some = np.flatnonzero(n[of_key] > 1)
    # whole anchors at a time, in parts of bounded size
    some = some[np.argsort(key[rep][some], kind="stable")]
    lo = 0
    while lo < len(some):
        hi = min(len(some), lo + PART)
        while hi < len(some) and key[rep[some[hi]]] == key[rep[some[hi - 1]]]:
            hi += 1
        part = some[lo:hi]
        ctx, at, bucket = refine(np.ascontiguousarray(rows[rep[part]]), size[rep[part]], length)
        least = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
        own = ids[rep[part]][ctx]
        np.minimum.at(least, bucket, own)
        hit = least[bucket] < own
        np.bitwise_or.at(bits, part[ctx[hit]], np.uint32(1) << at[hit].astype(np.uint32))
        lo = hi
    out = np.where(ids > ids[rep][group], full, bits[group])
    return np.split(out, np.cumsum([x.num_rows for x in tables])[:-1])


def removed_runs(block: Block, asked: Asked, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs in the block's bytes.
    ``bits`` belongs to the distinct contexts; a context that is not the first
    of its group has all its strings in a smaller or equal document."""
    rep_id = asked.ids[asked.rep][asked.group] if len(asked.group) else np.zeros(0, np.int64)
    mine = bits[asked.group] if len(asked.group) else np.zeros(0, np.uint32)
    size = asked.last - asked.first + 1
    full = ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    mine = np.where(asked.ids > rep_id, full, mine)
    whole = mine == full
    starts, ends = [asked.first[whole]], [asked.last[whole] + block.length]
    part = ~whole & (mine != 0)
    for j in range(int(size[part].max()) if part.any() else 0):
        at = asked.first[part][(mine[part] >> np.uint32(j)) & np.uint32(1) == 1] + j
        starts.append(at)
        ends.append(at + block.length)
    start, end = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(order) else end
    if not len(start):
        return start, end
    # a run ends where nothing before the next start reaches it
    cut = np.flatnonzero(start[1:] > end[:-1])
    return start[np.append(0, cut + 1)], end[np.append(cut, len(end) - 1)]


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q,
             hot: int = HOT, keep_text: bool = True, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """``(<id_col>, n_bytes, spans, kept_sha256, kept)``: the removed byte
    runs ``(start, end)`` of every row and what is left of it, as bytes or
    with ``as_text`` its whole characters; columns named in ``carry`` come
    along unchanged."""
    if length - q + 1 > 31:
        raise ValueError(f"strings of {length} bytes with anchors of {q}: at most 31 strings may share an anchor (a bit each)")
    src = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"),
                      *[F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)])
    n = block_count(src, F.octet_length("text"), BLOCK_BYTES)
    blocks = pack_blocks(src.withColumn("block", block_of("id", n, "text"))).repartition(n, "block")
    # the smallest id of each distinct text; payloads of ids alone
    num = F.col("id").cast("long")
    firsts = (src.select("id", "text").filter(F.col("id").isNotNull() & (F.octet_length("text") >= length))
              .select(num.alias("i"), F.sha2("text", 256).alias("h")).groupBy("h").agg(F.min("i").alias("i"))
              .select(F.col("i").cast("string").alias("id")))
    firsts = pack_blocks(firsts.withColumn("block", block_of("id", n)))

    def facts(df: DataFrame, kind: int) -> DataFrame:
        cols = {c: F.col(c) if c in df.columns else F.lit(-1) for c in ("block", "bucket")}
        return df.select(*[v.cast("int").alias(c) for c, v in cols.items()], F.lit(kind).alias("kind"), "payload")

    def load(left: pd.DataFrame, right: pd.DataFrame) -> Block:
        give_back()  # what the block before held
        ids = unpack(right.loc[right["kind"] == 0, "payload"])
        return Block(unpack(left["payload"]), set(ids["id"].to_pylist()) if ids is not None else set(), length, q)

    def states(block: Block, right: pd.DataFrame) -> np.ndarray:
        """The answers about anchors, in the order of ``block.keys``."""
        out = np.zeros(len(block.keys), np.uint8)
        bucket = (block.keys % np.uint64(n)).astype(np.int64)
        for r in right[right["kind"] == 1].itertuples():
            out[bucket == r.bucket] = np.unpackbits(np.frombuffer(r.payload, np.uint8).reshape(2, -1), axis=1)[
                :, :int((bucket == r.bucket).sum())].sum(axis=0)
        return out

    def ask_anchors(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = load(left, right)
        bucket = (block.keys % np.uint64(n)).astype(np.int64)
        rows = [(int(left["block"].iloc[0]), int(b), pack_keys(block.keys[bucket == b], block.docs_of[bucket == b]))
                for b in np.unique(bucket)] if len(left) else []
        del block, bucket
        give_back()
        return pd.DataFrame(rows, columns=["block", "bucket", "payload"])

    def answer_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        got = judge_anchors(list(pdf["payload"]), hot)
        give_back()
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"],
                             "payload": [np.packbits(np.stack([s >= 1, s == 2]), axis=1).tobytes() for s in got]})

    def ask_contexts(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = load(left, right)
        rows = [(int(left["block"].iloc[0]), b, p) for b, p in block.asked(states(block, right), n).requests()] if len(left) else []
        del block
        give_back()
        return pd.DataFrame(rows, columns=["block", "bucket", "payload"])

    def answer_contexts(pdf: pd.DataFrame) -> pd.DataFrame:
        got = judge_contexts(list(pdf["payload"]), length)
        give_back()
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"],
                             "payload": [to_payload(pa.table({"bits": x})) for x in got]})

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = load(left, right)
        asked = block.asked(states(block, right), n)
        bits = np.zeros(len(asked.rep), np.uint32)
        for r in right[right["kind"] == 2].itertuples():
            bits[asked.bucket == r.bucket] = from_payload(r.payload)["bits"].to_numpy()
        starts, ends = removed_runs(block, asked, bits)
        place = {k: j for j, k in enumerate(block.used)}
        held = unpack(left["payload"]).drop_columns(["text"]) if len(left) else None
        extra = [held[f"carry{i}"].to_pylist() for i in range(len(carry))] if held is not None else []
        ids = unpack(right.loc[right["kind"] == 0, "payload"])
        firsts_here = set(ids["id"].to_pylist()) if ids is not None else set()
        rows = []
        for k, (i, text) in enumerate(block.rows):
            if k in place:
                lo, hi = block.start[place[k]], block.start[place[k] + 1]
                a, b = np.searchsorted(starts, [lo, hi])
                # a run may go on from one text to the next: it is cut there
                if a and ends[a - 1] > lo:
                    a -= 1
                runs = [(int(max(s, lo) - lo), int(min(e, hi) - lo)) for s, e in zip(starts[a:b], ends[a:b])]
            else:  # a copy of a whole text, or nothing to compare
                copy = i is not None and len(text) >= length and i not in firsts_here
                runs = [(0, len(text))] if copy else []
            edges = [0, *(x for r in runs for x in r), len(text)]
            kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
            row = (i, len(text), [{"start": s, "end": e} for s, e in runs], hashlib.sha256(kept).hexdigest())
            left_over = kept.decode("utf-8", "ignore") if as_text else kept
            rows.append(row + (left_over,) * keep_text + tuple(x[k] for x in extra))
        out = pd.DataFrame(rows, columns=["id", "n_bytes", "spans", "kept_sha256"] + ["kept"] * keep_text + names)
        del block, asked, starts, ends, rows
        give_back()
        # whole numbers with nulls must not become floats
        return out.astype({c: object for c in names}) if not extra else out.assign(
            **{c: pd.Series(x, dtype=object) for c, x in zip(names, extra)})

    names = [f"carry{i}" for i in range(len(carry))]

    ask = "block int, bucket int, payload binary"
    by_block = lambda df: df.groupBy("block")
    known0 = facts(firsts, 0)
    anchors = by_block(blocks).cogroup(by_block(known0)).applyInPandas(ask_anchors, ask)
    answers = anchors.groupBy("bucket").applyInPandas(answer_anchors, ask)
    known1 = known0.unionByName(facts(answers, 1))
    contexts = by_block(blocks).cogroup(by_block(known1)).applyInPandas(ask_contexts, ask)
    verdicts = contexts.groupBy("bucket").applyInPandas(answer_contexts, ask)
    known2 = known1.unionByName(facts(verdicts, 2))
    out = "id string, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string" + f", kept {'string' if as_text else 'binary'}" * keep_text
    out += "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry))
    kind = docs.schema[id_col].dataType.simpleString()
    return (by_block(blocks).cogroup(by_block(known2)).applyInPandas(cut, out)
            .withColumn("id", F.col("id").cast(kind))
            .withColumnsRenamed({"id": id_col, **dict(zip(names, carry))}))
