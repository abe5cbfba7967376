"""The pipeline's stages, one by one and together."""

import corpus_pipeline
from stellate.llm import toxicity

FOLDER = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    names, counts = [n for n, _ in corpus_pipeline.STAGES], [docs.count()]
    assert names == ["toxicity", "quality rules", "MinHash near-dedup", "PII", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns, name
        rows, before = after.collect(), {r["doc_id"] for r in docs.collect()}
        kept = {r["doc_id"] for r in rows}
        clean = {d for d, r in labels.items() if r["toxic"] == 0 and r["quality"] == 1}
        assert kept <= before
        if name == "toxicity":
            assert not (clean & before) - kept
        if name == "PII":
            assert kept == before and not any("555-" in r["text"] and "+1 (" in r["text"] for r in rows)
        counts.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    packed = corpus_pipeline.packed(spark, docs, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
    assert toxicity.GRADES > 2
