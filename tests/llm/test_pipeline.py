"""The stages against what their operators decide, on a small corpus."""

import corpus_pipeline
from keyloom.llm import ngram_join, registry
from keyloom.llm.queries import QUERIES

from .conftest import invented


def test_stages(spark, make_docs, tmp_path):
    clean = [(i, invented(i, 120)) for i in range(20)]
    copy = (30, clean[0][1])
    near = (31, clean[1][1].replace("\n", " ").replace("ba ", "ba,", 1))
    short = (32, "too short to keep")
    passage = invented(77, 40)
    dirty = (33, passage + invented(78, 60))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs([*clean, copy, near, short, dirty])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    ids = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
        ids.append({r.doc_id for r in left.select("doc_id").collect()})
    assert ids[0] == {*range(20), 30, 31, 33}
    assert ids[1] == {*range(20), 31, 33}
    assert ids[2] == {*range(20), 33}
    assert ids[3] == set(range(20))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(range(20))


def test_registered():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))
    assert set(registry.ORACLES) <= set(QUERIES)


def test_near_copies_on_five_words(spark, make_docs):
    """Two scattered changes in a hundred words: near on sets of five words at 0.8, not on three at 0.9."""
    words = [f"word{i}" for i in range(100)]
    edited = [*words[:30], "changed", *words[31:60], "again", *words[61:]]
    docs = make_docs([(1, " ".join(words)), (2, " ".join(edited)), (3, invented(3, 100))])
    assert {r.doc_id for r in ngram_join.keep_one(docs).collect()} == {1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()} == {1, 3}
