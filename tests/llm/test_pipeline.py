"""The pipeline's stages: each works on what the one before kept, and columns stay."""

import corpus_pipeline
from haltwise.llm import decontamination, near_duplicates
from haltwise.llm.common import stash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < docs.count() <= n
        n = docs.count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.find_contaminated(docs, bench).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n and last.where("NOT round_trip").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in last.collect()}


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for df in (odd, empty):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            docs = stash(stage(spark, docs, SF), name)
        assert docs.count() <= df.count()


def test_dedup_leaves_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = stash(near_duplicates.drop_near_duplicates(docs, shingle=5), "left")
    again = near_duplicates.near_duplicates(left, shingle=5)
    assert again.where("NOT kept").count() == 0


def test_results_of_one_stage_stand_side_by_side(spark):
    """Two lazy results of a stage in one session, read after each other and after the next stage has begun."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality, dedup = (f for _, f in corpus_pipeline.STAGES[:2])
    even, odd = quality(spark, docs.where("doc_id % 2 = 0"), SF), quality(spark, docs.where("doc_id % 2 = 1"), SF)
    n = odd.count()
    deduplicated = dedup(spark, odd, SF)
    assert even.count() > 0 and n > 0 and 0 < deduplicated.count() <= n
    corpus_pipeline.run(spark, SF)
    assert even.count() > 0 and deduplicated.count() <= n
