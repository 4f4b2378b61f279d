"""The chunk store: only what changes is embedded, and tables follow the documents."""

from pyspark.sql import functions as F

from plain import plain_chunks
from quire.operators import chunk_store, versions

TEXTS = {"a": "one two\n\n" + "x" * 990 + "\n\nthree", "b": "copy of a text", "c": "copy of a text", "d": "", "e": None, "f": "s. " * 2000}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id string, text string")


def counting(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(contents):
        def run(it):
            for pdf in it:
                seen.add(len(pdf))
                yield pdf[["content_hash"]].assign(embedding=[[float(len(t))] for t in pdf["content"]])
        return contents.mapInPandas(run, "content_hash string, embedding array<double>")
    return seen, embed


def held(spark, base):
    out = {}
    for r in versions.read(spark, base).orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r.doc_id, []).append(r.content)
        assert r.embedding == [float(len(r.content))]
    return out


def test_refresh_embeds_only_new_contents(spark, scratch):
    base = f"{scratch}/chunks"
    seen, embed = counting(spark)
    want = lambda t: {k: plain_chunks(v) for k, v in t.items() if plain_chunks(v)}
    chunk_store.refresh(frame(spark, TEXTS), base, embedder=embed, buckets=4)
    distinct = {c for v in TEXTS.values() for c in plain_chunks(v)}
    assert held(spark, base) == want(TEXTS) and seen.value == len(distinct)
    number = versions.version(spark, base).number
    chunk_store.refresh(frame(spark, TEXTS), base, embedder=embed)
    assert seen.value == len(distinct) and versions.version(spark, base).number == number
    # one text changes, one goes, one is emptied, one is a copy of what is stored
    then = {**TEXTS, "a": TEXTS["a"] + "\n\nfour", "d": "copy of a text", "f": ""}
    del then["c"]
    chunk_store.refresh(frame(spark, then), base, embedder=embed)
    assert held(spark, base) == want(then)
    assert seen.value == len(distinct) + len({c for c in plain_chunks(then["a"])} - distinct)
    chunk_store.refresh(frame(spark, {}), base, embedder=embed)
    assert held(spark, base) == {}


def test_default_vectors_equal_the_embedder(spark, scratch):
    from quire.operators.embedding import python_hash_embedder
    base = f"{scratch}/chunks"
    chunk_store.refresh(frame(spark, TEXTS), base)
    rows = versions.read(spark, base).collect()
    plain = python_hash_embedder(normalize=False)([r.content for r in rows])
    assert [list(r.embedding) for r in rows] == plain


def test_chunks_that_swap_places_are_seen(spark, scratch):
    base = f"{scratch}/chunks"
    first, second = "x" * 900, "y" * 900
    chunk_store.refresh(frame(spark, {"a": f"{first}\n\n{second}"}), base)
    chunk_store.refresh(frame(spark, {"a": f"{second}\n\n{first}"}), base)
    got = versions.read(spark, base).orderBy("chunk_index").select(F.substring("content", 1, 1).alias("c")).collect()
    assert [r.c for r in got] == ["y", "x"]


def test_first_refresh_keeps_no_copy_of_its_rows(spark, scratch, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    kept, written = [], []
    persist, write = DataFrame.persist, versions._write_rows
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: kept.append(self) or persist(self, *a))
    monkeypatch.setattr(versions, "_write_rows", lambda rows, *a: written.append(rows) or write(rows, *a))
    chunk_store.refresh(frame(spark, TEXTS), f"{scratch}/chunks")
    assert not kept
    # nothing is looked for in a table that isn't there
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
    assert {r.doc_id for r in versions.read(spark, f"{scratch}/chunks").collect()} == {"a", "b", "c", "f"}
    assert chunk_store.refresh(frame(spark, {"d": ""}), f"{scratch}/none") is None
    assert versions.version(spark, f"{scratch}/none") is None
