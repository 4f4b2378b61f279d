from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.text import py_strip, word_count
from plain import plain_chunks
from quire.operators import chunking

EDGE = [
    None, "", "   ", "a" * 1000, "a" * 1001, "b" * 2001, "p1\n\n\n\n\n\np2", "\t  padded  \t",
    "one. two. three. ", "ends with dot. ", "accents é à ü and emoji 😀 here.",
    "x" * 600 + "\n\n" + "y" * 600, ("sentence number. " * 200), "short\n\nparagraphs\n\nonly",
    ("w" * 2500) + ". tail", " lead and trail　",
]


def _native(spark, texts, size=1000):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = chunking.chunk_documents(df, size=size) \
        .select("doc_id", "chunk_index", "content", "token_count")
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.content, r.token_count))
    return {k: [c for _, c, _ in sorted(v)] for k, v in got.items()}, out


def test_edge_rows_match_python(spark):
    got, _ = _native(spark, EDGE)
    for i, t in enumerate(EDGE):
        assert got.get(i, []) == plain_chunks(t or "", 1000), (i, t)


def test_long_texts_match(spark):
    big = ("word " * 30 + ". ") * 20000                     # ~3.2M characters, several thousand chunks
    got, _ = _native(spark, [big])
    assert got[0] == plain_chunks(big, 1000)


def test_sentence_fallback_appends_dot(spark):
    got, _ = _native(spark, ["A" * 2500 + ". B."])
    assert got[0][-1].endswith("..")


def test_token_count_is_python_split(spark):
    _, out = _native(spark, EDGE)
    for r in out.collect():
        assert r.token_count == len(r.content.split())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab .\n\t é")), max_size=120), min_size=1, max_size=6))
def test_fold_equals_python_property(spark, texts):
    got, _ = _native(spark, texts, size=20)
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_chunks(t, 20)


def test_window_chunks(spark):
    texts = ["", "a" * 10, "x" * 512, "y" * 513, "z" * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(chunking.window_chunks(F.col("text"), 512, 50).alias("w")).collect()
    for t, r in zip(texts, rows):
        exp, k = [], 0
        while len(t) > 0:
            exp.append(t[k * 462:k * 462 + 512])
            if k * 462 + 512 >= len(t):
                break
            k += 1
        assert r.w == exp


def test_strip_and_word_count(spark):
    vals = ["  a b  ", " x ", "", "one\ttwo\nthree"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    rows = df.select(py_strip(F.col("t")).alias("s"), word_count(F.col("t")).alias("n")).collect()
    assert [r.s for r in rows] == [v.strip() for v in vals]
    assert [r.n for r in rows] == [len(v.split()) for v in vals]


def test_udtf_equals_native(spark):
    from quire.functions.udtf import register_chunk_text
    register_chunk_text(spark)
    spark.createDataFrame([(i, t) for i, t in enumerate(EDGE) if t is not None], "id int, text string") \
        .createOrReplaceTempView("edge_docs")
    u = spark.sql("select d.id, c.chunk_index, c.content from edge_docs d, lateral chunk_text(d.text, 1000) c")
    got = {}
    for r in u.collect():
        got.setdefault(r.id, []).append((r.chunk_index, r.content))
    for i, t in enumerate(EDGE):
        if t is not None:
            assert [c for _, c in sorted(got.get(i, []))] == plain_chunks(t, 1000)
    # null sizes and the default, and nothing but native expressions in the plan
    one = spark.sql("select c.content from lateral chunk_text('a. b', null) c").collect()
    assert [r.content for r in one] == [r.content for r in spark.sql("select content from chunk_text('a. b')").collect()] == ["a. b"]
    small = spark.sql("select content from chunk_text('aa bb. cc dd. ee', 5)").collect()
    assert [r.content for r in small] == plain_chunks("aa bb. cc dd. ee", 5)
    assert "Python" not in u._jdf.queryExecution().toString()
