"""Exact dedup, periodic runs and collocations against brute-force versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import collocations, digests, periods
from quire.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, n long, row string, kept int, id string, sha double, phrase int, start int"


def frame(spark, rows):
    """Rows of (id, text, lang) with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, g, 7, "r", 1, "x", 0.5, 3, 4) for i, t, g in rows], DOCS)


def values(df):
    cols = sorted(df.columns)
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in df.select(*cols).collect()), key=repr)


def by_sql(name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.execute(ORACLES[name])
    cols = [c[0] for c in got.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    assert values(QUERIES[name](spark, SF)) == by_sql(name)


# ------------------------------------------------------------------ copies

def plain_copies(rows, largest):
    groups = defaultdict(list)
    for k, (i, t, _) in enumerate(rows):
        groups[t or ""].append((i, k))
    out = []
    for t, members in groups.items():
        named = [i for i, _ in members if i is not None]
        keep = (max if largest else min)(named) if named else None
        out += [(i, keep, len(members), hashlib.sha256(t.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits,round_bits", [(0, 4), (3, 1), (5, 2), (None, 4)])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_copies_at_every_shape_of_the_tree(spark, keep, bits, round_bits):
    rng = random.Random(5)
    texts = [None, "", " ", "é", "é", "long " * 40_000] + [f"t{j}" for j in range(40)]
    rows = [(rng.choice([None, 3, 5, *range(-20, 300), 1 << 60]), rng.choice(texts), "en") for _ in range(600)]
    rows += [(1000 + j, "hot", "en") for j in range(300)] + [(None, "nobody", "en")] * 3
    docs = frame(spark, rows).repartition(7)
    got = digests.copies(docs, keep=keep, bits=bits, round_bits=round_bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain_copies(rows, keep == "largest")
    stay = Counter(r.text_sha256 for r in got if r.kept)
    assert set(stay.values()) == {1} and len(stay) == len({t or "" for _, t, _ in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_texts_under_one_sort_key_are_told_apart():
    def run(rows):
        cols = list(zip(*rows))
        kinds = [np.uint64] * 4 + [np.int64, np.int8, np.int64, np.int64, np.int64]
        return {c: np.array(v, t) for c, v, t in zip(digests.FIELDS, cols, kinds)}
    # one sort key, three texts in turn: other digest bits, other length
    a = run([(9, 1, 1, 1, 5, 1, 10, 0, 1), (9, 1, 1, 2, 5, 1, 11, 1, 1), (9, 1, 1, 1, 6, 1, 12, 2, 1)])
    b = run([(9, 1, 1, 1, 5, 1, 4, 3, 2), (9, 1, 1, 2, 5, 0, 0, 4, 1)])
    got = digests.merge_runs([a, b], False)
    assert sorted(zip(got["k3"].tolist(), got["n_bytes"].tolist(), got["id"].tolist(), got["n"].tolist())) == [
        (1, 5, 4, 3), (1, 6, 12, 1), (2, 5, 11, 2)]


def test_distinct_rows_keep_their_columns(spark):
    rows = [(2, "a", "en"), (1, "a", "de"), (3, None, "fr"), (4, "", None)]
    docs = frame(spark, rows)
    got = digests.distinct_rows(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r)[:3] for r in got.collect()) == [(1, "a", "de"), (3, None, "fr")]
    assert digests.copies(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        digests.copies(docs, keep="any")


# -------------------------------------------------------------------- runs

def plain_runs(words, least):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e > s and e - s + q >= max(least, 2 * q):
                found.setdefault((s, e - s + q), q)
            s = max(e, s) + 1
    return sorted(((s, m, q) for (s, m), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_are_all_maximal_repetitions():
    rng = random.Random(2)
    cases = [[], ["a"], ["a"] * 40, list("ab" * 9), list("aab" * 6 + "aab"), list("abcabc" * 3 + "x" + "abc" * 4)]
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        w = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        if w and rng.random() < 0.7:
            a = rng.randrange(len(w))
            p = rng.randint(1, max(1, (len(w) - a) // 2))
            w = w[:a] + [w[a + i % p] for i in range(len(w) - a)] + [rng.choice(letters) for _ in range(rng.randint(0, 20))]
        cases.append(w)
    for w in cases:
        for least in (12, 3, 2, 7):
            assert periods.runs_of(w, least) == plain_runs(w, least), (w, least)


@pytest.mark.parametrize("words,n", [(["a"] * 300_000, 1), (["a", "b", "a"] * 100_000, 1),
                                     ([str(i % 1000) for i in range(300_000)], 1), ([str(i) for i in range(300_000)], 0)])
def test_runs_of_very_long_texts(words, n):
    import time
    t0 = time.time()
    got = [r for r in periods.runs_of(words) if r[1] > 100_000]
    assert len(got) == n and time.time() - t0 < 60


def test_runs_of_odd_rows(spark):
    rows = [(None, "a b " * 20, "en"), (1, None, "en"), (2, "", "en"), (2, "x y\x1cz\x85 " * 7, None), (2, " \t\n", "en"),
            (1 << 60, "p q r s " * 4 + "p q", "en")]
    docs = frame(spark, rows)
    got = sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, [tuple(x) for x in r.runs], r.collapsed)
                  for r in periods.find_runs(docs).collect()), key=repr)
    assert got == sorted([(None, 1, 0, 40, 2, [(0, 40, 2)], "a b"), (1, 0, None, None, None, [], ""), (2, 0, None, None, None, [], ""),
                          (2, 0, None, None, None, [], " ".join(["x y\x1cz\x85"] * 7)), (2, 0, None, None, None, [], ""),
                          (1 << 60, 1, 0, 18, 4, [(0, 18, 4)], "p q r s")], key=repr)
    assert periods.find_runs(docs.limit(0)).count() == 0


def test_op12_on_the_fixture(spark):
    want = []
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    for r in rows:
        w = [x.decode() for x in (r.text or "").encode().split()]
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w, 12)
        s, m, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), plain_collapsed(w, runs))]
        want.append((r.doc_id, len(runs), s, m, q, 1000 * m // q if runs else None, *sha))
    got = QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_runs > 0 for r in got) > 15


# ------------------------------------------------------------ collocations

def plain_phrases(rows, least, longest, top):
    import re
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        cand = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        rest = []
        for p, a in cand.items():
            if any(len(o) > len(p) and b >= a and any(o[i:i + len(p)] == p for i in range(len(o) - len(p) + 1))
                   for o, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows(rng, n=400):
    words = ["Ab", "b", "c", "É", "é", "z z", "DD"]
    line = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ".\n", " "]) for _ in range(rng.randint(0, 30)))
    return [(i, rng.choice([None, "", "b c Ab b c. ", line(), line(), line()]), rng.choice([None, "und", "en", "fr"])) for i in range(n)]


@pytest.mark.parametrize("shards,least", [(4, 20), (1, 20), (3, 7), (7, 60)])
def test_collocations_equal_brute_force(spark, shards, least):
    rows = phrase_rows(random.Random(shards))
    docs = frame(spark, rows).repartition(5)
    got = collocations.collocations(docs, threshold=least, top=30, shards=shards)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, 5, 30)


def test_collocations_with_a_crowded_filter(spark, monkeypatch):
    """Slots that collide start phrases early, and counts stay the same."""
    rows = phrase_rows(random.Random(9), 200)
    docs = frame(spark, rows).repartition(3)
    want = sorted(map(tuple, collocations.phrase_counts(docs, threshold=10)[0].collect()))
    monkeypatch.setattr(collocations, "slots", lambda h, size: np.zeros((1, len(h)), np.int64))
    assert sorted(map(tuple, collocations.phrase_counts(docs, threshold=10)[0].collect())) == want


def test_a_phrase_starts_once_its_parts_are_frequent():
    words, codes = collocations.numbered(b"A b\ta  B.,\n")
    assert words.to_pylist() == ["a", "b"] and codes.tolist() == [0, 1, 2, 1, 2, 0]
    seen = np.full(1 << 16, collocations.NEVER, np.uint8)

    def step(s):
        out = {}
        for k, place, _, first in collocations.phrases_of(words, codes, "en", seen, s, 5):
            for p in place[first + 4 > s].tolist():
                numbers = [p] if k == 1 else codes[p:p + k].tolist()
                phrase = " ".join(words[c - 1].as_py() for c in numbers)
                out[phrase] = out.get(phrase, 0) + (codes.tolist().count(p) if k == 1 else 1)
        return out
    assert step(0) == {"a": 2, "b": 2} and step(4) == {}
    for _, _, h, _ in list(collocations.phrases_of(words, codes, "en", seen, 0, 5)):
        seen[collocations.slots(h[0], len(seen))] = 2   # both words are found frequent in step 2
    assert step(2) == {"a": 2, "b": 2}
    assert step(3) == {"a": 2, "b": 2, "a b": 2, "b a": 1} and step(6) == {"a b": 2, "b a": 1} and step(7) == {}


def test_hashes_of_words_and_sums_of_hashes():
    import pyarrow as pa
    words = ["", "a", "b", "ab", "ba", "é", "x" * 64, "x" * 65, "y" + "x" * 64, "x" * 64 + "y", "x" * 200, "a"]
    h = collocations.word_hashes(pa.array(words[1:])).T.tolist()
    assert h[0] == h[-1] and len({tuple(x) for x in h}) == len(words) - 2
    assert collocations.word_hashes(pa.array(["zz", *words[1:]]).slice(1)).T.tolist() == h
    # two phrases under one first hash
    h = np.array([[5, 5, 3, 5, 5], [1, 2, 1, 1, 2]], np.uint64)
    at, d, n = collocations.added_up(h, np.array([1, 10, 100, 1000, 10_000]))
    assert d.T.tolist() == [[3, 1], [5, 1], [5, 2]] and n.tolist() == [100, 1001, 10_010]
    assert h[:, at].tolist() == d.tolist()


def test_strata_with_odd_names_stay_apart(spark):
    rows = [(i, "a b. ", lang) for lang, n in (("", 3), (" ", 4), ("x", 5), (None, 6), ("und", 1)) for i in range(n)]
    got = {(r.stratum, r.phrase): r.n for r in collocations.phrase_counts(frame(spark, rows), threshold=3)[0].collect()}
    assert got == {(s, p): n for s, n in (("", 3), (" ", 4), ("x", 5), ("und", 7)) for p in ("a", "b", "a b")}


def test_collocations_of_nothing(spark):
    docs = frame(spark, [(1, None, "en"), (2, "", None), (3, " . ,\n", "en")])
    for d in (docs, docs.limit(0)):
        assert collocations.collocations(d).count() == 0


def test_collocations_of_large_counts(spark):
    """Scores are exact where products pass 64 bits."""
    rows = spark.createDataFrame([("en", "a b", 2, 4 * 10 ** 9, 5 * 10 ** 9, 6 * 10 ** 9, 9 * 10 ** 12)],
                                 "stratum string, phrase string, k int, a long, l long, r long, n long")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    got = rows.select((F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).alias("t"), (exact("l") * exact("r")).alias("u"))
    assert got.selectExpr("t div u AS s").first()["s"] == 1000 * 4 * 10 ** 9 * 9 * 10 ** 12 // (30 * 10 ** 18)


def test_a_frequent_phrase_is_named_by_one_piece(spark):
    docs = frame(spark, [(i, f"a b c {i % 3}", "en") for i in range(60)]).repartition(6)
    pieces = collocations.tokenised(docs, "text", "lang", 2).drop("n_words").localCheckpoint()
    held = {r.piece for r in pieces.collect()}
    assert len(held) == pieces.count() >= 6    # every piece has all phrases
    seen = spark.sparkContext.broadcast(np.zeros(1 << 16, np.uint8).tobytes())
    counts = (collocations.step_counts(pieces, seen, 5, 9, 3, 1, 20).select("counts").withColumn("step", F.lit(5)).localCheckpoint())
    frequent = collocations._matching([counts], np.ones(1 << 16, bool), -1).filter("n >= 20").localCheckpoint()
    assert frequent.count() == frequent.filter(F.col("piece").isin(held)).count() > 5
    got = collocations._named(pieces, frequent, seen, 9, 3, 4).collect()
    assert len(got) == frequent.count() and {r.stratum for r in got} == {"en"}
    assert {r.phrase: r.n for r in got if r.phrase[0] in "ab"} == {"a": 60, "b": 60, "a b": 60, "b c": 60, "a b c": 60, "b c 0": 20, "b c 1": 20, "b c 2": 20}
