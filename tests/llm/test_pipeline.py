"""The pipeline's stages on a small table, each against its plain version."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import secrets, stages
from quire.llm.queries import vocabulary

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    """The input of each stage and its result."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        from quire.llm.common import materialize
        got = materialize(got, f"test-{name}")
        if name != "packing":
            assert got.columns == columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        out[name] = (docs, got)
        docs = got
    return out


def test_toxic_documents_go_and_clean_ones_stay(spark, kept):
    docs, got = kept["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in got.collect()}
    rows = docs.collect()
    clean = [r.doc_id for r in rows if labels.get(r.doc_id) == 0]
    assert sum(i in left for i in clean) >= 0.98 * len(clean)
    loud = [r.doc_id for r in rows if r.text.count("idiot") + r.text.count("moron") + r.text.count("scum") >= 3]
    assert not any(i in left for i in loud)


def test_one_of_each_class_stays(spark, kept):
    import sys
    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_documents import plain_set
    docs, got = kept["jaccard"]
    sets = {r.doc_id: plain_set(r.text, 5) for r in docs.collect()}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    for a, b in {(x, y) for v in by.values() for x in v for y in v if x < y}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    assert {r.doc_id for r in got.collect()} == {i for i in ids if find(i) == i}


def test_no_string_repeats_from_smaller_documents(spark, kept):
    import sys
    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_documents import plain_removals
    docs, got = kept["suffixes"]
    want = {i: (b.decode("utf-8", "ignore"), bool(runs)) for i, runs, b in plain_removals([(r.doc_id, r.text) for r in docs.collect()])}
    rows = {r.doc_id: r for r in got.collect()}
    for i, (text, cut) in want.items():
        if text or not cut:
            assert rows[i].text == text and rows[i].n_chars == len(text)
        else:
            assert i not in rows


def test_secrets_are_masked(kept):
    docs, got = kept["secrets"]
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count()
    for r in docs.collect():
        base = secrets.base_spans(r.text)
        assert not [s for s in secrets.base_spans(rows[r.doc_id].text) if s[2] != "assign"]
        for a, b, k in base:
            assert r.text[a:b] not in rows[r.doc_id].text
        assert rows[r.doc_id].n_chars == len(rows[r.doc_id].text)


def test_packing_keeps_what_came_in(kept):
    import sys
    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_tokens import check_packing
    docs, got = kept["packing"]
    room, used = check_packing(docs.collect(), got.collect())
    assert used > 0.95 * room


def test_stages_on_odd_tables(spark):
    rows = [(0, None, "en", "s", 0, 1.5), (None, "text of nobody " * 20, None, None, None, None), (1, "", "en", "s", 0, 2.0),
            (2, "é" * 100, "en", "s", 100, 3.0), (3, "x" + "é" * 100 + "y", "fr", "s", 102, 4.0), (3, "again", "fr", "s", 5, 4.0),
            (1 << 60, "token = " + "ab12" * 10, "en", "s", 48, 5.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for table in (docs, docs.limit(0)):
        n = table.count()
        assert stages.drop_toxic(table, labels).count() == n
        assert stages.drop_near_copies(table).count() == n
        cut = {(r.doc_id, r.text, r.id) for r in stages.cut_repeats(table).collect()}
        assert len(cut) == n and (not n or {(0, None, 1.5), (3, "xy", 4.0), (1, "", 2.0)} <= cut)
        masked = {(r.doc_id, r.text) for r in stages.mask_secrets(table).collect()}
        assert len(masked) == n and (not n or {(1 << 60, "[SECRET]"), (0, None)} <= masked)
        assert stages.pack(table, vocabulary("byte_bpe_50k.json")).filter("start = 0").count() == n
    assert random.Random(0) and docs.filter(F.col("doc_id").isNull()).count() == 1


def test_repeats_are_cut_whatever_other_columns_are_called(spark):
    names = ["kept", "spans", "n_bytes", "kept_sha256", "_null", "id", "block", "payload", "kind", "carry0", "_other0", "bucket"]
    rows = [(1, "x" * 60 + "ab", *range(12)), (2, "cd" + "x" * 60, *range(12)), (3, None, *[None] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)).withColumn("n_chars", F.length("text"))
    got = {r.doc_id: tuple(r) for r in stages.cut_repeats(docs).collect()}
    assert got[1] == (*rows[0], 62) and got[3] == (*rows[2], None)
    assert got[2] == (2, "cd", *range(12), 2)
    for name in names:      # one at a time, too
        one = docs.select("doc_id", "text", name)
        assert stages.cut_repeats(one).columns == one.columns and stages.cut_repeats(one).count() == 3
