import corpus_pipeline
from twinset.llm import common, registry

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert [sum(n.startswith(f"op{i}_") for n in registry.queries()) for i in range(1, 11)] == [1] * 10


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    ids, now = [], docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, DATA).persist()
        assert now.columns == docs.columns, name
        ids.append([r["doc_id"] for r in now.select("doc_id").collect()])
    assert all(labels[i] for i in ids[0] if i in labels)
    assert ids[1] != [] and sorted(ids[1]) == sorted(ids[0])
    shingles = lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    texts = [(r["doc_id"], shingles(r["text"])) for r in now.collect()]
    for i, (a, x) in enumerate(texts):
        for b, y in texts[:i]:
            assert len(x & y) < 0.8 * len(x | y), (a, b)
    packed = corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, now, DATA), DATA)
    assert packed.count() > 0


def test_stages_leave_no_tables_but_what_their_result_reads(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        before = common.made()
        out = stage(spark, docs, DATA)
        assert common.made() == before + 1, name
        table = spark.read.parquet(common._made[-1][1])
        assert not {"text", "_row"} & set(table.columns), name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
