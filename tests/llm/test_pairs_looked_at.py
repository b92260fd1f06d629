"""How many pairs a group makes whose members share most of a template but are not linked."""

import numpy as np
import pytest

pytest.importorskip("quadweave.llm")
from quadweave.llm import near_dups


def test_group_below_the_threshold(spark, monkeypatch):
    """Pairs grow with the members, not with their square; the few links between them are all found."""
    rng = np.random.default_rng(31)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(600):
        words = list(base)
        for k in rng.choice(150, 6, replace=False):
            words[k] = f"d{i}x{k}"
        texts.append(words)
    texts += [[*w[:75], "another", *w[76:]] for w in texts[::20]]
    looked, likely = [], near_dups._likely
    monkeypatch.setattr(near_dups, "_likely", lambda pairs, *rest: looked.append(pairs.count()) or likely(pairs, *rest))
    got = near_dups.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), threshold=80)
    component = {r["doc_id"]: r["component_id"] for r in got.collect()}

    sets = [{tuple(w[k : k + 5]) for k in range(146)} for w in texts]
    want = list(range(len(sets)))
    find = lambda i: i if want[i] == i else find(want[i])
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if 100 * shared >= 80 * (len(x) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                want[b] = a
    assert component == {i: find(i) for i in range(len(sets))}
    assert sum(looked) < 40 * len(texts)
