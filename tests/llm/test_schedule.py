import pytest

pytest.importorskip("quadweave.llm")
from pyspark.sql import functions as F
from quadweave.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    return spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"), F.element_at(F.array(F.lit("a"), F.lit("a"), F.lit("b"), F.lit(None), F.lit("c")), (F.col("id") % 5 + 1).cast("int")).alias("source"))


def test_every_stretch_of_the_mix_has_about_the_target_shares(spark, docs):
    rows = mixing.mixed_documents(docs.filter("text <> ''"), slot_col="slot", block_words=64).toPandas()
    assert rows["slot"].is_monotonic_increasing
    rows["size"] = rows["text"].str.count("w")
    share = rows.groupby(rows["source"].fillna("-"))["size"].sum() / rows["size"].sum()
    for k in range(4):
        part = rows[(rows["slot"] * 4 // (rows["slot"].max() + 1)) == k]
        here = part.groupby(part["source"].fillna("-"))["size"].sum() / part["size"].sum()
        assert (abs(here - share) < 0.05).all()


def test_another_sequence_is_another_mix(spark, docs):
    one, same, other = (mixing.mix(docs, keep=("doc_id",), block_words=64, step=s).select("doc_id", "slot", "taken").toPandas().sort_values("doc_id", ignore_index=True) for s in (mixing.STEP, mixing.STEP, 987654321))
    assert one.equals(same) and not one["slot"].equals(other["slot"]) and one["taken"].equals(other["taken"])


def test_slots_are_a_bijection_with_blocks(spark, docs):
    targets = mixing.source_targets(docs.select(F.col("source").alias("_source"), F.regexp_count("text", F.lit("w")).cast("long").alias("_size")))
    slots = mixing.schedule(targets, 16).toPandas()
    assert sorted(slots["slot"]) == list(range(len(slots)))
    for _, g in slots.groupby("source_no"):
        assert list(g.sort_values("slot")["block"]) == list(range(len(g)))
