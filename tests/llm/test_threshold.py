import pytest

pytest.importorskip("quadweave.llm")
import corpus_pipeline
from quadweave.llm import near_dups


def test_pipeline_drops_pairs_between_the_thresholds(spark):
    """200 words of which the last 20 differ: 176 of 216 shingles, a similarity of 0.81."""
    base = [f"w{i}" for i in range(200)]
    far = [f"v{i}" for i in range(200)]
    texts = [(1, " ".join(base)), (2, " ".join(base[:180] + [f"x{i}" for i in range(20)])), (3, " ".join(far)), (4, " ".join(far[:170] + [f"y{i}" for i in range(30)]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3, 4]
    assert {r["doc_id"] for r in near_dups.near_duplicates(docs).filter("kept").collect()} == {1, 2, 3, 4}


def test_bands_follow_from_the_threshold():
    assert near_dups.bands_for(85) == (36, 8)
    for threshold in (70, 80, 85, 90):
        bands, rows = near_dups.bands_for(threshold)
        assert (1 - (threshold / 100) ** rows) ** bands <= 1 / near_dups.MISSED
