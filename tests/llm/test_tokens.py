"""SentencePiece chunk table and packing against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import packing, pieces
from quire.llm.queries import QUERIES, vocabulary

ODD = [None, "", " ", "  ", "a", " a", "a ", "  a  b ", "a\n b", "a\n\n b\t c  d", "▁", "a▁b ▁▁c", "don't 's 've x's ' s",
       "naïve ﬁ Ａ    x", "\u0000 \u0001", "日本語 テキスト🙂🙂", "<s> </s> <unk> <0x0A>", "<|endoftext|> a<|endoftext|>b",
       "x" * 5000, "word " * 3000, "1234567890 12.5 ²³ ½", "\r\n\r\n a", "a \n", "   \n\n   ", "é é ̈ x"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab \n\t'▁é,") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (3, "twice", "x", 1), (3, "twice", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, n_tokens int")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_pieces_equal_the_library(odd):
    sp = pieces.processor(vocabulary("piece_bpe_32k.model"))
    got = pieces.encode(odd, vocabulary("piece_bpe_32k.model")).collect()
    want = []
    for r in odd.collect():
        ids = sp.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)), ids, sp.decode(ids)))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


def test_words_of_a_block_and_their_requests():
    """Words are found and dealt for a whole block at a time."""
    texts = [*ODD, "b a", "a ", ""]
    words, codes, order, count = pieces._words(texts)
    names = words.to_pylist()
    assert names == sorted(set(names)) and sorted(order.tolist()) == list(range(len(texts)))
    end = np.cumsum(count)
    for i, lo, hi in zip(order.tolist(), (end - count).tolist(), end.tolist()):
        assert [names[c] for c in codes[lo:hi]] == pieces.marked_words(texts[i] or "")
    places, req = pieces._requests(words, 5)
    assert sorted(places.tolist()) == list(range(len(names)))
    assert [lo for _, lo, _ in req] == [0, *[hi for _, _, hi in req][:-1]] and req[-1][2] == len(names)
    assert pieces._requests(words.slice(0, 0), 5)[1] == [] and len(pieces._words([None, ""])[0]) == 0
    assert pieces._taken(np.arange(9), np.array([7, 0, 2, 2]), np.array([2, 0, 3, 1])).tolist() == [7, 8, 2, 3, 4, 2]


def test_op1_on_the_fixture(spark):
    sp = pieces.processor(vocabulary("piece_bpe_32k.model"))
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op1_sentencepiece"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = sp.encode(d.text)
        assert got[d.doc_id].ids_sha256 == sha(",".join(map(str, ids)))
        assert got[d.doc_id].decoded_sha256 == sha(sp.decode(ids))


def check_packing(docs, got, capacity=1024):
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == {d.doc_id for d in docs}
    for d in docs:
        ids = np.array(tk.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and 0 < r.length
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(seqs) * capacity, sum(r.length for r in got)


def test_chunks_are_encoded_as_by_the_tokenizer():
    """All distinct chunks of a larger fixture, and random strings."""
    import pyarrow.parquet as pq
    path = vocabulary("byte_bpe_50k.json")
    tk, special = packing._load(path), packing._tokenizer(path)[0]
    assert packing._ranked(tk) is not None and special == ["<|endoftext|>"]
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    rng = random.Random(9)
    texts += ["".join(rng.choice(["a", "b", "the", "'s", "'", "ll", " ", "\n", "12", "é", "ß", "日", "🙂", ".", "-", "_", "\u00a0", "\u0301", "½"])
                      for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    for t, got in zip(texts, packing.tokenize(texts, path)):
        assert np.frombuffer(got, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids


def test_distinct_words_are_encoded_in_one_call(monkeypatch):
    """As many calls as texts have edges, whatever words are between; white
    space of all kinds, alone and in runs, at edges and between."""
    path = vocabulary("byte_bpe_50k.json")
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(400)) for _ in range(20)]
    calls = []
    special, (ranked, widths) = packing._tokenizer(path)

    class Counted:
        def encode_to_numpy(self, text, **more):
            calls.append(text)
            return ranked.encode_to_numpy(text, **more)
    monkeypatch.setattr(packing, "_tokenizer", lambda _: (special, (Counted(), widths)))
    tk = packing._load(path)
    got = packing.tokenize(texts, path)
    assert len(calls) <= 1 + 2 * len(texts)
    bits = ["a", "the", "12", ".", "\x1c", "\u200b", " ", " ", "  ", "\n", "\t", "\x0b", "\x85", "\u2003", "\u3000", "<|endoftext|>"]
    odd = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None]
    for t, ids in zip(texts + odd, got + packing.tokenize(odd, path)):
        assert np.frombuffer(ids, "<u4").tolist() == tk.encode(t or "", add_special_tokens=False).ids


def test_packing_keeps_every_token(odd):
    docs = odd.filter("doc_id is not null and not (doc_id = 3 and text = 'twice')")
    room, used = check_packing(docs.collect(), packing.pack(docs, vocabulary("byte_bpe_50k.json")).collect())
    assert room - used < 1024 * 20


def test_packing_repeated_and_null_ids(odd):
    got = packing.pack(odd, vocabulary("byte_bpe_50k.json"), keep_ids=False)
    n = got.filter("start = 0").count()
    assert n == odd.count()


def test_op2_on_the_fixture(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op2_packing"](spark, sf).collect()
    room, used = check_packing(spark.read.parquet(f"{sf}/documents.parquet").collect(), got)
    assert used > 0.9 * room


def test_balance_spreads_cost():
    lengths = np.array([1000, 900, 500, 400, 300, 200, 100, 24, 3000, 1024])
    used, got = packing.balance(lengths)
    assert sum(n for _, _, n, _ in got) == lengths.sum() and (used <= 1024).all()
    assert -(-lengths.sum() // 1024) <= len(used) <= -(-lengths.sum() // 1024) + 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(none, vocabulary("piece_bpe_32k.model")).count() == 0
    assert packing.pack(none, vocabulary("byte_bpe_50k.json")).count() == 0
    assert pieces.encode(none.select("doc_id", F.lit(None).cast("string").alias("text")),
                         vocabulary("piece_bpe_32k.model")).count() == 0
