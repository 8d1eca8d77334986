"""The pipeline's stages on planted rows."""

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    given = "/root/testdata/sf0.001"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{given}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs = spark.read.parquet(f"{given}/documents.parquet")
    item = spark.read.parquet(f"{given}/benchmark.parquet").orderBy("item_id").first().text
    passage = " ".join(f"phrase{i}" for i in range(60))
    clean = " ".join(f"clean{i}" for i in range(80))
    rows = [(9000, clean), (9001, clean.upper()), (9002, f"first part {passage} of one"), (9003, f"second {passage} of two " + " ".join(f"more{i}" for i in range(200))),
            (9004, item), (9005, None), (None, "no id at all"), (9006, "")]
    extra = spark.createDataFrame([(i, t, "en", "planted", None if t is None else len(t)) for i, t in rows], docs.schema)
    docs.unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_planted_rows(spark, planted):
    out = corpus_pipeline.run(spark, planted)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = out.where("source = 'planted'").collect()
    got = {r.doc_id: r for r in rows}
    assert set(got) == {9000, 9002, 9003, 9005, None, 9006} and len(rows) == 6
    assert "phrase7" in got[9002].text and "phrase" not in got[9003].text and "more7" in got[9003].text
    assert got[9003].n_chars == len(got[9003].text)
    assert all(r.round_trip for r in rows)


def test_stages_take_empty_and_odd_tables(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").selectExpr("*", "1 AS score", "'x' AS removed_words", "2 AS ids", "3 AS kept")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), planted)
        assert empty.count() == 0, name
        if n < len(corpus_pipeline.STAGES) - 1:
            assert empty.columns == docs.columns, name
            assert stage(spark, docs, planted).columns == docs.columns
