"""Groups of near copies larger than a bucket whose pairs are all looked at."""

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("quadweave.llm")
import brute
from quadweave.llm import near_dups, oracles


def test_star_subgroups_and_truncated_copies(spark, monkeypatch):
    """Members near a common text but apart from each other; some share a change; some are cut short."""
    monkeypatch.setattr(near_dups, "SMALL", 2)
    monkeypatch.setattr(near_dups, "SMALL_LATER", 2)
    rng = np.random.default_rng(21)
    base = [f"b{i}" for i in range(150)]

    def changed(n, tag):
        words = list(base)
        for k in rng.choice(150, n, replace=False):
            words[k] = f"{tag}x{k}"
        return words

    texts = [(i, changed(int(rng.integers(1, 12)), f"d{i}")) for i in range(120)]
    sub = changed(6, "sub")
    texts += [(200 + i, [*sub[: 10 * i % 140], f"s{i}", *sub[10 * i % 140 + 1 :]]) for i in range(40)]
    texts += [(300 + i, base[: 60 + 2 * i]) for i in range(45)]
    texts += [(400 + i, base[3 * i :]) for i in range(30)]
    df = pd.DataFrame([(i, " ".join(w)) for i, w in texts], columns=["doc_id", "text"])
    got = near_dups.near_duplicates(spark.createDataFrame(df)).toPandas()
    assert brute.rows(got) == brute.rows(brute.sql(oracles.NEAR_DUPS, documents=df))


def test_registers_of_short_and_long_sets():
    """Equal registers follow the similarity, for texts with fewer shingles than registers too."""
    rng = np.random.default_rng(5)
    for n, other in ((4, 1), (40, 8), (400, 80), (4000, 800)):
        shares = []
        for _ in range(40):
            all_ = np.unique(rng.integers(0, 1 << 63, n + 2 * other, dtype="uint64") * np.uint64(2))
            a, b = near_dups.registers([np.sort(all_[other:]), np.sort(all_[: all_.size - other])], 288)
            sizes = np.array([n + other])
            shares.append(near_dups.estimate(a[None], b[None], sizes, sizes)[0])
        assert abs(np.mean(shares) - n / (n + 2 * other)) < 0.06


def test_collision_term():
    """The share of equal registers of unrelated sets is the one that is taken off."""
    rng = np.random.default_rng(6)
    for n, m in ((3000, 3000), (20_000, 2000)):
        found = [np.mean(np.equal(*near_dups.registers([rng.integers(0, 1 << 63, k, dtype="uint64") * np.uint64(2) for k in (n, m)], 288))) for _ in range(60)]
        assert abs(np.mean(found) - near_dups.collisions(np.array([n]), np.array([m]), 288)[0]) < 5e-4
