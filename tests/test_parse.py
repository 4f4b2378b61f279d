from pyspark.sql import functions as F

from quire.operators import parse


def _df(spark):
    rows = [
        ("a", '{"document":{"pages":[{"content":"hello","footer":null,"header":"H","id":0,"page_number":1},'
              '{"content":null,"header":"H2","id":1,"page_number":2},{"content":"no id","page_number":3}]}}'),
        ("b", '{"document":{"pages":[],"elements":[1,2]}}'),
        ("c", '{"document":{"pages":[{"content":"x","id":0,"page_number":1}],"_corrupted_data":"oops"}}'),
        ("d", "{bad"),
    ]
    return spark.createDataFrame(rows, "path string, parsed string").withColumn("user_id", F.lit("u"))


def test_quarantine_and_variant_paths(spark):
    p = parse.parse_result(_df(spark))
    good, bad = parse.split_quarantine(p)
    assert sorted(r.path for r in good.collect()) == ["a", "b"]
    assert {r.path: r.reason for r in bad.collect()} == {"c": "corrupted", "d": "unparsable"}
    el = {r.path: r.e for r in p.select("path", F.expr("cast(elements as string)").alias("e")).collect()}
    assert el["b"] == "[1,2]"


def test_page_text_layout_and_nulls(spark):
    out = parse.page_chunks(_df(spark)).orderBy("chunk_index").collect()
    assert [r.path for r in out] == ["a", "a", "a"]            # empty / bad / corrupted give no pages
    assert out[0].text == "Content: [hello]\nFooter: []\nHeader: [H]\nID: [0]\nPage Number: [1]"
    assert out[1].text == "Content: []\nFooter: []\nHeader: [H2]\nID: [1]\nPage Number: [2]"
    assert out[2].page_id is None and out[2].text.endswith("ID: []\nPage Number: [3]")


def test_keep_empty_documents(spark):
    good, _ = parse.split_quarantine(parse.parse_result(_df(spark)))
    rows = parse.explode_pages(parse.typed_pages(good), keep_empty=True).collect()
    assert sorted((r.path, r.page_chunk is None) for r in rows) == [("a", False), ("a", False), ("a", False),
                                                                  ("b", True)]
