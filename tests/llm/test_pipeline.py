import pyarrow.parquet as pq

import corpus_pipeline
from lanewise.llm.common import durable, table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = durable(stage(spark, docs, FOLDER), name)
        sizes.append(docs.select("doc_id").distinct().count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert sizes[1] == sizes[2] == sizes[3] == sizes[4]
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    kept = {r["doc_id"] for r in corpus_pipeline.good(spark, table(spark, FOLDER, "documents"), FOLDER).collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
