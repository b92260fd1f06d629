import numpy as np
import pytest

pytest.importorskip("quadweave.llm")
import brute
from quadweave.llm import lines

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]


def own(rng, n):
    return [" ".join(rng.choice(WORDS, 12)) for _ in range(n)]


def dropped(spark, texts):
    """``{doc_id: lines that went}``."""
    got = lines.drop_lines(spark.createDataFrame(texts, "doc_id long, text string")).selectExpr("row.doc_id", "row.text as old", "text").collect()
    return {r["doc_id"]: [x for x in r["old"].split("\n") if x not in r["text"].split("\n")] for r in got}


def test_shared_lines_of_the_smallest_hashes(spark):
    """Header, footer and notice of unrelated documents hash below all their own lines."""
    rng = np.random.default_rng(11)
    some = sorted(own(rng, 400), key=brute._hash)
    shared, rest = some[:3], some[3:]
    texts = [(i, "\n".join([shared[0], *rest[4 * i : 4 * i + 4], *shared[1:]])) for i in range(12)]
    assert dropped(spark, texts) == {i: shared for i in range(12)}


def test_near_copies_stay_whole(spark):
    """Each copy has a line of its own, which must not make it an unrelated document."""
    rng = np.random.default_rng(12)
    base = own(rng, 20)
    texts = [(i, "\n".join([*base[:i], *own(rng, 1), *base[i + 1 :]])) for i in range(20)] + [(100 + i, "\n".join(base)) for i in range(5)]
    assert not any(dropped(spark, texts).values())


def test_copies_do_not_keep_a_line_in_other_documents(spark):
    rng = np.random.default_rng(13)
    line, copied = own(rng, 1)[0], own(rng, 6)
    alone = [(i, "\n".join([*own(rng, 3), line])) for i in range(20)]
    copies = [(100 + i, "\n".join([*copied, line])) for i in range(300)]
    got = dropped(spark, alone + copies)
    assert {i: got[i] for i, _ in alone} == dropped(spark, alone) == {i: [line] for i, _ in alone}
    assert not any(got[i] for i, _ in copies)


def test_short_lines_recur(spark):
    rng = np.random.default_rng(14)
    short = ["Les.", "Read more", "All rights reserved.", "Page 7"]
    texts = [(i, "\n".join([*own(rng, 3), "", *short, "", *own(rng, 3), f"Only w{chr(97 + i)}"])) for i in range(6)]
    assert dropped(spark, texts) == {i: short for i in range(6)}
    got = lines.drop_lines(spark.createDataFrame(texts, "doc_id long, text string")).select("n_lines", "n_dropped").distinct().collect()
    assert [tuple(r) for r in got] == [(13, 4)]


def test_two_templates_of_one_leaf_with_two_variables(spark):
    """Neither has most of the leaf's lines, and values of either variable are common by themselves."""
    rng = np.random.default_rng(15)
    names, places = [f"name{chr(97 + i)}" for i in range(8)], [f"place{chr(97 + i)}" for i in range(9)]
    texts = []
    for i in range(60):
        one = f"This page was last seen by {names[i % 8]} of the reading room in {places[i % 9]} and closed at once today"
        two = f"This page was sent on for {names[i % 8]} to the writing desk at {places[i % 9]} and opened by hand later"
        noise = [f"This page was {' '.join(rng.choice(WORDS, 14))}" for _ in range(3)]
        texts.append((i, "\n".join([*own(rng, 3), [one, two][i % 2], *noise])))
    assert dropped(spark, texts) == {i: [t.split("\n")[3]] for i, t in texts}


def test_many_lines_with_many_drops(spark):
    rng = np.random.default_rng(16)
    many = [f"line {a} of words" for a in WORDS[:150]]
    texts = [(i, "\n".join([*own(rng, 400), *many])) for i in range(5)] + [(9, "w " * 200_000)]
    got = dropped(spark, texts)
    assert all(got[i] == many for i in range(5)) and not got[9]
