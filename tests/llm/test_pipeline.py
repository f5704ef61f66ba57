"""The pipeline against a plain version of its stages."""

from collections import Counter

import corpus_pipeline
from test_llm import ROWS, SCHEMA, jaccard, near_copies, reference_ids, spans

from gristmill.llm import mixing, quality_rules


def test_stages(spark, tmp_path):
    rows = [(i, t, "en", ["a", "b"][i % 2], 1, "x") for i, t in near_copies()]
    spark.createDataFrame(rows, SCHEMA).drop("key").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in quality_rules.kept_documents(docs).collect()}
    groups = jaccard(list(kept.items()))
    one = {i: t for i, t in kept.items() if groups[i][0] == i}
    masked = {}
    for i, t in one.items():
        own = list(t)
        for a, _, b in spans(t):
            own[a:b] = "\u2588" * (b - a)
        masked[i] = "".join(own)
    after = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        after = stage(spark, after, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/s{k}")
        after = spark.read.parquet(f"{tmp_path}/s{k}")
    assert {r["doc_id"]: r["text"] for r in after.collect()} == masked
    copies = Counter(r["doc_id"] for r in mixing.mixture(after).collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == copies
    assert all(r["n_tokens"] == len(reference_ids(masked[r["doc_id"]])[0]) for r in got)
    assert len(ROWS) > 10
