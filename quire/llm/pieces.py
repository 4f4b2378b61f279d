"""SentencePiece encoding and decoding through a distinct-chunk table.

A SentencePiece BPE model whose pieces never hold a whitespace marker after
another character cannot join characters across the start of a marker run.
The normalised text therefore falls apart into *marked words* (a run of
markers and what follows it) that are segmented independently. Every distinct
marked word of the corpus is segmented once and its ids are joined back to
the positions where it stands:

1. documents are dealt into blocks (``common.pack_blocks``); a block asks for
   its distinct words, sent to the bucket that a hash of the word names;
2. a bucket gathers the requests of all blocks, segments each distinct word
   once and answers each block in the order in which it asked;
3. block and answers meet again; ids are read off by position, joined, and
   decoded with the library.

Shuffled are the compressed texts once, and each block's distinct words with
their ids. A frequent word is sent once per block, so it makes no hot key.

Defined results: null or empty text has no ids and decodes to ``""``; rows
with a null or repeated id are all kept, one result each; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.collocations import word_hashes
from quire.llm.common import block_count, block_of, from_payload, give_back, pack_blocks, to_payload, unpack, worker_cache

MARK = "▁"
#: Words whose ids are read off at a time.
TAKEN_WORDS = 1 << 19
_RUNS = re.compile(" +[^ ]*")
_CROSSES = re.compile(f"[^{MARK}]{MARK}")


def processor(path: str):
    """The model at ``path``, loaded once per Python worker. Raises when its
    pieces cross whitespace markers or it changes text before splitting."""
    kept = worker_cache()
    if ("pieces", path) not in kept:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(_CROSSES.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
            raise ValueError(f"{path}: pieces cross whitespace markers; a chunk table can't be used")
        if "".join(sp.encode("a  ﬁ B ", out_type=str)) != f"{MARK}a{MARK}{MARK}ﬁ{MARK}B{MARK}":
            raise ValueError(f"{path}: the model normalises its text; a chunk table can't be used")
        kept["pieces", path] = sp
    return kept["pieces", path]


def marked_words(text: str) -> list[str]:
    """The marked words of ``text`` in order, each without its first marker
    (which the text's start or the space before it gives)."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " ":
        return text.split(" ")
    return [w[1:] for w in _RUNS.findall(" " + text.replace(MARK, " "))]


def segment(sp, words: list[str]) -> list[list[int]]:
    """Ids of each marked word."""
    out = sp.encode(words, num_threads=1)
    lone = sp.piece_to_id(MARK)
    return [ids if w else [lone] for w, ids in zip(words, out)]


def _words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The marked words of some texts: the distinct ones, sorted; for each
    place the number of its word, text after text; the texts in that order
    (by their place in ``texts``) and how many words each has."""
    odd = [bool(t) and (MARK in t or "  " in t or t[0] == " ") for t in texts]
    order = [i for i, t in enumerate(texts) if t and not odd[i]]
    lists = pc.split_pattern(pa.array([texts[i] for i in order], pa.large_string()), pattern=" ")
    others = [i for i, t in enumerate(texts) if odd[i] or not t]
    rest = [marked_words(texts[i] or "") for i in others]
    count = np.concatenate([pc.list_value_length(lists).to_numpy(), np.fromiter(map(len, rest), np.int64, len(rest))]).astype(np.int64)
    found = pa.concat_arrays([lists.flatten(), pa.array([w for x in rest for w in x], pa.large_string())]).dictionary_encode()
    by_name = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    return found.dictionary.take(pa.array(by_name)), rank[found.indices.to_numpy()], np.array(order + others, np.int64), count


def _requests(words: pa.Array, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A block's distinct words by bucket, in an order that both sides know:
    the words' places, and ``(bucket, from, to)`` in these."""
    none = pa.scalar("", words.type)   # a word may be empty, what is hashed may not
    bucket = (word_hashes(pc.binary_join_element_wise(words, none, pa.scalar(" ", words.type)))[0] % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    some, lo = np.unique(bucket[order], return_index=True)
    return order, list(zip(some.tolist(), lo.tolist(), [*lo[1:].tolist(), len(order)]))


def _taken(flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, one after the other."""
    end = np.cumsum(length)
    return flat[np.repeat(first - end + length, length) + np.arange(end[-1] if len(end) else 0)]


def _ids_payload(length: np.ndarray, flat: np.ndarray) -> bytes:
    """Ids of each word: how many, and all in a row, in narrow numbers."""
    return to_payload(pa.table({"n": [length.astype("<u4").tobytes()], "ids": [flat.tobytes()], "width": [flat.itemsize]}))


def _ids_of(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    t = from_payload(payload)
    return (np.frombuffer(t["n"][0].as_py(), "<u4").astype(np.int64), np.frombuffer(t["ids"][0].as_py(), f"<u{t['width'][0].as_py()}"))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = True) -> DataFrame:
    """Encode and decode every text: ``(<id_col>, n_tokens, ids, decoded,
    ids_sha256, decoded_sha256)``. Without ``keep_ids`` the two large columns
    are left out and only the digests are returned."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    n = block_count(src, F.octet_length("text"))
    blocks = pack_blocks(src.withColumn("block", block_of("id", n, "text"))).repartition(n, "block")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, g in pdf.groupby("block"):
                words = _words(unpack(g["payload"])["text"].to_pylist())[0]
                order, req = _requests(words, n)
                yield pd.DataFrame({"block": np.full(len(req), block, np.int32), "bucket": [b for b, _, _ in req],
                                    "words": [to_payload(pa.table({"w": words.take(pa.array(order[lo:hi]))})) for _, lo, hi in req]})
        give_back()

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        sp = processor(model_path)
        asked = [from_payload(p)["w"].combine_chunks() for p in pdf["words"]]
        found = pa.concat_arrays(asked).dictionary_encode()
        ids = segment(sp, found.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), "<u2" if sp.get_piece_size() <= 1 << 16 else "<u4", int(length.sum()))
        first = np.cumsum(length) - length
        out, at = [], 0
        for mine in asked:
            i = found.indices[at:at + len(mine)].to_numpy()
            out.append(_ids_payload(length[i], _taken(flat, first[i], length[i])))
            at += len(mine)
        give_back()
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "ids": out})

    def assemble(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sp = processor(model_path)
        t = unpack(left["payload"])
        if t is None:
            return pd.DataFrame([], columns=cols)
        keys, texts = t["id"].to_pylist(), t["text"].to_pylist()
        words, codes, texts_at, count = _words(texts)
        # the same requests in the same order as in ask()
        order, req = _requests(words, n)
        got = dict(zip(right["bucket"], right["ids"]))
        length, first, flat, held = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, "<u2")], 0
        for bucket, lo, hi in req:
            many, ids = _ids_of(got[bucket])
            if len(many) != hi - lo:
                raise ValueError(f"bucket {bucket} answers {len(many)} of {hi - lo} words")
            length[order[lo:hi]], first[order[lo:hi]] = many, held + np.cumsum(many) - many
            flat.append(ids)
            held += len(ids)
        flat = np.concatenate(flat)
        names = pa.array([str(i) for i in range(sp.get_piece_size())], pa.large_string())
        end = np.concatenate([[0], np.cumsum(count)])
        rows, lo = [], 0
        while lo < len(keys):
            # texts of about so many words at a time, one at least
            hi = max(lo + 1, int(np.searchsorted(end, end[lo] + TAKEN_WORDS, "right")) - 1)
            some = codes[end[lo]:end[hi]]
            ids = _taken(flat, first[some], length[some])
            cut = np.concatenate([[0], np.cumsum(length[some])])[end[lo:hi + 1] - end[lo]]
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cut), names.take(pa.array(ids))), pa.scalar(",", names.type))
            ids, cut = ids.tolist(), cut.tolist()
            for i, text, a, b in zip(texts_at[lo:hi].tolist(), joined, cut, cut[1:]):
                mine = ids[a:b]
                decoded = sp.decode(mine)
                row = (keys[i], len(mine), hashlib.sha256(text.as_buffer()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append(row + (mine, decoded) if keep_ids else row)
            lo = hi
        give_back()
        return pd.DataFrame(rows, columns=cols)

    cols = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if keep_ids else [])
    kind = docs.schema[id_col].dataType.simpleString()
    out = "id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out += ", ids array<int>, decoded string" if keep_ids else ""
    requests = blocks.mapInPandas(ask, "block int, bucket int, words binary")
    answers = requests.groupBy("bucket").applyInPandas(answer, "block int, bucket int, ids binary")
    return (blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(assemble, out)
            .withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col))
