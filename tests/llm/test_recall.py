"""The index where it prunes: recall against brute force on more vectors than the given tables have."""

import numpy as np
import pytest

pytest.importorskip("quadweave.llm")
from quadweave.llm import neighbours


def test_recall_of_random_clustered_and_repeated_vectors(spark):
    rng = np.random.default_rng(31)
    centres = rng.normal(size=(60, 32))
    rows = np.concatenate([
        rng.normal(size=(8000, 32)) * 1.5,
        centres[rng.integers(0, 60, 9000)] * 1.6 + 0.4 * rng.normal(size=(9000, 32)),
        np.repeat(rng.normal(size=(1, 32)), 4000, axis=0),
    ]).astype("float32")
    order = rng.permutation(len(rows))
    rows = rows[order]
    ids = np.arange(len(rows)) * 5
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<float>")
    report = {}
    got = neighbours.search(df, every=500, report=report).toPandas()
    want = neighbours.exact(ids, rows.astype("float64"), every=500)
    found = got.sort_values("rank").groupby("query_id")["vec_id"].apply(list)
    assert set(found.index) == set(want)
    recall = np.mean([len(set(found[q]) & {i for i, _ in w}) / 20 for q, w in want.items()])
    print(report, "recall", recall)
    assert recall >= 0.93 and report["groups"] > 3 and report["probes"] < 0.4 * report["lists"]
