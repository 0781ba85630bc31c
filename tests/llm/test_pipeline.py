"""The pipeline's stages, one after the other, against their operators."""

import corpus_pipeline

from ..conftest import DATA
from .test_operators import check_packing, near_by_hand
from tesserae.llm import quality_crf, toxicity
from tesserae.llm.packing import pack
from tesserae.llm.queries import tokenizer_file


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns, inputs = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, inputs[-1], DATA)
        if k < 3:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        inputs.append(spark.read.parquet(str(tmp_path / str(k))))
    raw, good, mild, single, packed = inputs
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    assert ids(good) == ids(quality_crf.judge(raw, quality_crf.fit(raw, labels)).where("kept"))
    assert ids(mild) == ids(toxicity.score(good, toxicity.fit(good, labels)).where("predicted = 0"))
    assert ids(single) == {r[0] for r in near_by_hand([tuple(r) for r in mild.select("doc_id", "text").collect()]) if r[3]}
    texts = [tuple(r) for r in single.select("doc_id", "text").collect()]
    check_packing(packed, texts, 2048)
    check_packing(pack(single, tokenizer_file("word_bpe_49k.json")), texts, 2048)
    assert 0 < len(texts) < mild.count() + 1 < good.count() + 2 < raw.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_edge_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    odd = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "", "en", "s", 0), (None, "w " * 80, "en", "s", 160), (900_003, "long " * 60_000, "en", "s", 300_000)], docs.schema)
    mixed = docs.unionByName(docs.where("doc_id < 20")).unionByName(odd)
    for c in ("id", "text_", "kept", "score", "label", "toxic", "quality", "component", "set_key", "_gone", "_id", "_text", "_group", "_kept", "_one", "document", "digest", "stays"):
        mixed = mixed.withColumn(c, F.lit("x"))
    mixed.write.parquet(str(tmp_path / "documents.parquet"))
    want = {r[0] for r in corpus_pipeline.run(spark, DATA).select("doc_id").distinct().collect()}
    got = corpus_pipeline.run(spark, str(tmp_path))
    rows = got.select("doc_id", "piece").collect()
    ids = {r[0] for r in rows}
    # repeated rows and odd ones change nothing of the others, and texts without words are gone
    assert {i for i in ids if i is not None and i < 900_000} == want
    assert not ids & {900_001, 900_002}
    assert len(rows) == len(set(map(tuple, rows)))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
