import corpus_pipeline
from gleanery.session import written

SF = "/root/testdata/sf0.001"


def test_every_stage_decides_on_what_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), name)
        sizes.append(out.count())
        if name != "token_ids":
            assert out.columns == docs.columns
            known = docs.select("doc_id", "text").distinct()
            assert out.join(known, ["doc_id", "text"], "left_anti").where("text is not null").count() == 0
            docs = out
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5]
    rows = out.orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in docs.collect())


def test_stages_take_empty_tables_and_other_columns(spark, odd_docs, no_docs):
    for docs in no_docs, odd_docs:
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), name)
        assert docs.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_workers_give_memory_back(monkeypatch, spark):
    """Behind each batch the memory that Arrow has freed goes back to the system."""
    import pyarrow as pa

    from gleanery.llm import simhash, toxicity

    given = []

    class Pool:
        def release_unused(self):
            given.append(1)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    batches = [pa.array(["one two three", None]), pa.array(["four"]), pa.array([], pa.string())]
    lexicons = spark.sparkContext.broadcast([{"four": 1.0}])
    for name, found in (
        ("fingerprints", simhash.simhash.func(iter(batches))),
        ("features", toxicity.toxic_features(lexicons).func((b, pa.array([0] * len(b))) for b in batches)),
        ("terms", toxicity.distinct_terms.func(iter(batches))),
    ):
        given.clear()
        assert [len(x) for x in found] == [2, 1, 0], name
        assert len(given) == 3, name
