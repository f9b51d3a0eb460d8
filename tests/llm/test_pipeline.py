from collections import Counter

from colophon.llm import ngram_join, quality
from tests.conftest import DATA


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made, columns = docs, docs.columns
    seen = []
    for name, stage in p.STAGES:
        made = stage(spark, made, DATA).cache()
        seen.append(made)
        if name != p.STAGES[-1][0]:
            assert made.columns == columns, name
    good, single, hidden, mixed, packed = seen
    ranker = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    keep = {r.doc_id for r in quality.scored(docs, ranker, keep=["doc_id"]).collect() if r.score >= quality.CUT}
    assert {r.doc_id for r in good.collect()} == keep
    groups = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(good).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(k for k, c in groups.items() if k == c)
    assert hidden.count() == single.count()
    assert set(r.doc_id for r in mixed.collect()) <= set(groups)
    assert Counter(r.doc_id for r in packed.collect()) == Counter(r.doc_id for r in mixed.collect())
    assert p.run(spark, DATA).count() == packed.count()
