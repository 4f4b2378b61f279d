"""Cost-balanced packing of token sequences.

Attention over a piece of ``n`` tokens costs about ``linear * n + quadratic *
n**2``. Documents are tokenised where they are read and dealt by a hash of
their id into pools of bounded size. In a pool, a document gives as many full
sequences as it fills; what remains of it is assigned in descending order of
cost to the lowest-cost sequence whose remaining capacity holds it. When no
sequence can hold it whole, it is cut over the lowest-cost sequences with
capacity left. A pool opens just as many sequences as its tokens need, so at
most one sequence of a pool is padded.

Tokenising uses that byte-level BPE never joins characters across a single
space between two other characters: texts are cut there, the distinct words of
``BATCH_BYTES`` of texts are encoded in one call, and the ids of all texts are
read off in arrays.

Defined results: a null or empty text is the end id alone; rows with a null or
repeated id are packed one by one; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import block_count, block_of, from_payload, give_back, packed, worker_cache

CAPACITY = 1024
BATCH_BYTES = 8 << 20
#: Unicode white space, as the split pattern means it.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_RUN = f"[{_WHITE}]{{2}}"
#: Before the last of several white spaces, which goes with what follows.
_LAST = re.compile(f"(?<=[{_WHITE}])(?=[{_WHITE}][^{_WHITE}])")


#: Fixed value: the split pattern of plain byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte:
    printable Latin-1 stands for itself, the rest follow from code 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(tk):
    """The tokenizer's vocabulary as ranks, which tiktoken encodes about three
    times as fast, and the bytes of each id, or None where merges don't follow
    the order of ids (the tokenizer then does all the work itself). The tests
    hold the two against each other."""
    import json

    import tiktoken
    spec = json.loads(tk.to_str())
    vocab, added = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    byte = _byte_of()
    if merged != sorted(merged) or not set("".join(vocab.keys() - added)) <= byte.keys():
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    widths[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), widths


def _load(path: str):
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _tokenizer(path: str) -> tuple:
    """Special texts and ranks of a tokenizer, kept per Python worker (where
    ranks do the work, the tokenizer itself is not)."""
    kept = worker_cache()
    if ("packing", path) not in kept:
        tk = _load(path)
        if tk.pre_tokenizer is None or "ByteLevel" not in type(tk.pre_tokenizer).__name__ or tk.normalizer is not None:
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        special = [t.content for t in tk.get_added_tokens_decoder().values()]
        kept["packing", path] = (special, _ranked(tk))
    return kept["packing", path]


def _by_words(texts: list[str], ranked, widths: np.ndarray) -> list[bytes]:
    """Ids of texts in which white spaces stand beside each other at the end
    at most. A text is its first word and each other one with the space before
    it; first and last words may have white space at an edge and are encoded by
    themselves, the distinct others as one text."""
    def encode(text: str) -> np.ndarray:
        return ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    body = [t.rstrip(_WHITE) for t in texts]
    split = pc.split_pattern(pa.array(body, pa.large_string()), " ")
    at = split.offsets.to_numpy()
    first, last = at[:-1], at[1:] - 1
    inner = np.ones(at[-1], bool)
    inner[first] = inner[last] = False
    words = split.values.filter(pa.array(inner)).dictionary_encode()
    # the text " a b c" of the words a, b and c
    all_words = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
    one = encode("".join(" " + t for t in pc.binary_join(all_words, pa.scalar(" ", pa.large_string())).to_pylist() if t))
    ends = np.cumsum(pc.binary_length(words.dictionary).to_numpy().astype(np.int64) + 1)
    made = np.cumsum(widths[one])
    upto = np.searchsorted(made, ends, "right")
    if len(ends) and not np.array_equal(made[upto - 1], ends):
        raise ValueError("a token spans two words")
    # at the edges: of a text of one word that, else the first and the last
    edge, place = [], np.empty(at[-1], np.int64)
    place[inner] = words.indices.to_numpy()
    for t, b, lo, hi in zip(texts, body, first.tolist(), last.tolist()):
        if lo < hi:
            place[lo] = len(ends) + len(edge)
            edge.append(encode(b[:b.index(" ")]))
        place[hi] = len(ends) + len(edge)
        edge.append(encode(t[b.rindex(" "):] if lo < hi else t))
    sizes = np.concatenate([np.diff(upto, prepend=0), [len(e) for e in edge]]).astype(np.int64)
    bounds = 4 * np.cumsum(np.concatenate([[0], sizes]))
    known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [
        None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.concatenate([one, *edge]).astype("<u4"))])
    got = known.take(pa.array(place))
    cut = np.frombuffer(got.buffers()[1], np.int64)[:len(got) + 1][at].tolist()
    ids = memoryview(got.buffers()[2])
    return [bytes(ids[lo:hi]) for lo, hi in zip(cut, cut[1:])]


def tokenize(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    special, ranked = _tokenizer(path)
    out: list = [None] * len(texts)
    texts = [t or "" for t in texts]
    whole = [i for i, t in enumerate(texts) if ranked is None or any(s in t for s in special)]
    if whole:  # special texts are cut out by the tokenizer itself
        tk = _load(path)
        for i in whole:
            out[i] = array("I", tk.encode(texts[i], add_special_tokens=False).ids).tobytes()
    rest = [i for i, b in enumerate(out) if b is None]
    if rest:
        runs = pc.match_substring_regex(pa.array([texts[i] for i in rest], pa.large_string()), _RUN).to_pylist()
        parts = [_LAST.split(texts[i]) if run else [texts[i]] for i, run in zip(rest, runs)]
        ids = iter(_by_words([x for p in parts for x in p], *ranked))
        for i, p in zip(rest, parts):
            out[i] = b"".join([next(ids) for _ in p])
    return out


def balance(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = 1.0,
            quadratic: float = 1.0 / CAPACITY) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Assign pieces of documents of ``lengths`` tokens to sequences.

    Returns the number of tokens of each sequence and the pieces as
    ``(document, start, length, sequence)``, each sequence's in its order."""
    full = lengths // capacity
    pieces = [(int(d), int(j) * capacity, capacity, 0) for d in np.flatnonzero(full) for j in range(full[d])]
    n_full = len(pieces)
    pieces = [(d, s, n, i) for i, (d, s, n, _) in enumerate(pieces)]
    rest = lengths - full * capacity
    total = int(rest.sum())
    bins = -(-total // capacity)
    room = np.full(bins, capacity, np.int64)
    if bins:
        room[-1] = total - capacity * (bins - 1)
    used, cost = room.copy(), np.zeros(bins)
    for d in np.argsort(-rest, kind="stable"):
        left, start = int(rest[d]), int(full[d]) * capacity
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            b = int(np.argmin(np.where(fits, cost, np.inf)))
            n = min(left, int(room[b]))
            pieces.append((int(d), start, n, n_full + b))
            room[b] -= n
            cost[b] += linear * n + quadratic * n * n
            left, start = left - n, start + n
    return np.concatenate([np.full(n_full, capacity, np.int64), used]), pieces


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pieces of packed sequences: ``(<id_col>, start, length, ids_crc32,
    doc_tokens, sequence_id, offset)`` and, with ``keep_ids``, the ids."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    n = block_count(src, F.octet_length("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(sizes) - sizes) // BATCH_BYTES
            cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cut, cut[1:]):
                part = b.slice(lo, hi - lo)
                ids = [x + end for x in tokenize(part.column("text").to_pylist(), tokenizer_path)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("block"), pa.array(ids, pa.binary())],
                                                 names=["id", "block", "ids"])
        give_back()

    def one_pool(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()  # what the pool before held
        t = pa.concat_tables([from_payload(p) for p in pdf["payload"]])
        names, ids = t["id"].to_pylist(), t["ids"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (names[i] is None, names[i], ids[i]))
        ids, names = [ids[i] for i in order], [names[i] for i in order]
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        used, pieces = balance(lengths, capacity)
        at = np.zeros(len(used), np.int64)
        rows = []
        for d, start, length, s in pieces:
            data = ids[d][4 * start:4 * (start + length)]
            row = (names[d], start, length, zlib.crc32(data), int(lengths[d]), (int(key[0]) << 32) + s, int(at[s]))
            rows.append(row + (np.frombuffer(data, "<u4").astype(np.int32),) if keep_ids else row)
            at[s] += length
        return pd.DataFrame(rows, columns=cols)

    cols = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    out = "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    # tokenized and packed in one worker: each holds executor memory
    blocks = src.withColumn("block", block_of("id", n, "text")).mapInArrow(lambda b: packed(ids_of(b)), "block int, payload binary")
    return (blocks.repartition(n, "block").groupBy("block")
            .applyInPandas(one_pool, out + ", ids array<int>" * keep_ids).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col))
