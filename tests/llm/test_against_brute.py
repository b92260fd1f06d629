import json
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

pytest.importorskip("quadweave.llm")
import brute
import corpus_pipeline
from quadweave.llm import lines, near_dups, neighbours, oracles, packing, queries, substrings, token_counts
from quadweave.llm._common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def pairs(df):
    return list(df[["doc_id", "text"]].itertuples(index=False, name=None))


def check_places(got, capacity=4096):
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= capacity
    assert got["sequence_id"].nunique() <= math.ceil(got["length"].sum() / capacity * 1.02) + 1


def keys(got):
    return Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))


def test_op1(spark, docs, tokenizer):
    got = queries.op1_packing(spark, SF).toPandas()
    assert keys(got) == brute.pieces(pairs(docs), tokenizer)
    check_places(got)


def test_sequences_hold_the_ids(spark, tokenizer):
    texts = [(1, "One two."), (2, "Ünïcode 日本語 123 don't <|endoftext|>"), (3, "word " * 90), (4, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    packed = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), capacity=64, with_ids=True).toPandas()
    got = {r["sequence_id"]: r["ids"] for r in packing.sequences(spark.createDataFrame(packed)).collect()}
    for r in packed.itertuples():
        part = np.array((tokenizer.encode(dict(texts)[r.doc_id] or "", add_special_tokens=False).ids + [1])[r.start : r.start + r.length], "<u4").tobytes()
        assert bytes(got[r.sequence_id])[4 * r.offset : 4 * (r.offset + r.length)] == part


def test_fullest_is_the_largest_sum():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = Counter(rng.integers(1, 12, 7).tolist())
        room = int(rng.integers(1, 40))
        used = packing.fullest(dict(counts), sorted(counts, reverse=True), room)
        sums = {0}
        for size in counts.elements():
            sums |= {s + size for s in sums}
        assert sum(k * v for k, v in used.items()) == max(s for s in sums if s <= room)
        assert all(v <= counts[k] for k, v in used.items())


def test_op2(spark, docs):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = queries.op2_substrings(spark, SF).toPandas()
    assert Counter(got[cols].itertuples(index=False, name=None)) == brute.repeats(pairs(docs), 400)


def test_substrings_of_one_letter_and_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(1)
    shared = ["".join(rng.choice(list("abc "), 150)) for _ in range(3)]
    texts = [(i, "".join(rng.choice(list("abcdefgh "), int(rng.integers(0, 120)))) + shared[i % 3][: int(rng.integers(60, 150))] + "é" * int(rng.integers(0, 90))) for i in range(60)]
    texts += [(100, "a" * 500), (101, "ab" * 200 + "x" + "ab" * 60), (102, None), (103, ""), (104, shared[0]), (105, shared[0])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute.repeats(texts, 80)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for group in (15_000, 5):
        monkeypatch.setattr(substrings, "GROUP_ROWS", group)
        got = substrings.remove_repeats(df, length=80, with_text=True).toPandas()
        assert Counter(got[cols].itertuples(index=False, name=None)) == want


def test_op3_recall_and_scores(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    ids, m = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype("float64")
    want = neighbours.exact(ids, m)
    got = queries.op3_neighbours(spark, SF).toPandas()
    at = {i: k for k, i in enumerate(ids)}
    hits = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g["vec_id"])
        assert np.allclose(g["score"], m[[at[i] for i in g["vec_id"]]] @ m[at[q]], rtol=1e-12)
        assert list(zip(-g["score"], g["vec_id"], strict=True)) == sorted(zip(-g["score"], g["vec_id"], strict=True))
        hits += len({i for i, _ in want[q]} & set(g["vec_id"]))
    assert set(got["query_id"]) == set(want) and hits >= 0.9 * 20 * len(want)


def test_op4(spark, docs):
    got = queries.op4_line_dedup(spark, SF).toPandas()
    assert dict(pairs(got)) == brute.line_dedup(pairs(docs))


def test_templates_across_documents(spark):
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    own = lambda: "\n".join(" ".join(rng.choice(words, 12)) for _ in range(4))
    user = lambda: str(rng.choice(words))
    texts = [(i, own() + f"\nLogged in as user {user()} at gate {i} on {i}:00 today\n" + own() + "\nAll rights reserved worldwide, 2024.") for i in range(12)]
    texts += [(20 + i, texts[0][1]) for i in range(4)] + [(30, None), (31, ""), (32, "\n\n")]
    got = dict(pairs(lines.drop_lines(spark.createDataFrame(texts, "doc_id long, text string")).selectExpr("row.doc_id", "text").toPandas()))
    assert {k: v if isinstance(v, str) else None for k, v in got.items()} == brute.line_dedup(texts)
    assert "Logged in as" not in got[3] and "rights reserved" not in got[3] and got[3].count("\n") == 7


def test_op5(spark, docs):
    vocabulary = set(json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())["model"]["vocab"])
    letters = dict(enumerate(packing._byte_letters()))
    spell = lambda w: letters[32] + w.encode().decode("latin-1").translate(letters)
    want = Counter()
    for i, text in pairs(docs):
        words = brute.WORD.findall(text or "")
        want[i, len(words), len((text or "").encode()), sum(brute.greedy_pieces(spell(w), vocabulary) for w in words)] += 1
    assert Counter(queries.op5_token_counts(spark, SF).toPandas().itertuples(index=False, name=None)) == want


def test_automaton_on_small_vocabularies():
    rng = np.random.default_rng(4)
    for _ in range(50):
        vocabulary = {"a", "b", *("".join(rng.choice(["a", "b"], int(rng.integers(1, 6)))) for _ in range(6))}
        machine = token_counts.PieceAutomaton(sorted(vocabulary))
        for _ in range(20):
            word = "".join(rng.choice(["a", "b"], int(rng.integers(0, 15))))
            assert machine.count(word) == brute.greedy_pieces(word, vocabulary)
        assert machine.count("aXb") == 1


def test_op7(spark):
    m = pd.read_parquet(f"{SF}/conversations.parquet")
    got = queries.op7_chat(spark, SF).toPandas().astype(object)
    got = Counter(tuple(None if pd.isna(x) else x for x in r) for r in got.itertuples(index=False))
    assert got == brute.chat(list(m[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql(spark, name):
    frames = {t: pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages")}
    assert brute.rows(queries.queries()[name](spark, SF).toPandas()) == brute.rows(brute.sql(oracles.SQL[name], **frames))


def test_near_copies_in_chains_and_large_groups(spark):
    rng = np.random.default_rng(6)
    base = rng.choice(5000, 200)
    texts = []
    for i in range(80):  # each a little further from the first
        texts.append((i, " ".join(f"t{x}" for x in np.r_[rng.choice(9000, i) + 5000, base[i:]])))
    texts += [(200 + i, texts[40][1].upper()) for i in range(30)]
    other = rng.choice(9000, 120) + 20_000
    texts += [(300 + i, " ".join(f"t{x}" for x in np.r_[other, [50_000 + i] * 2])) for i in range(40)]
    texts += [(400, "one two"), (401, "One  two"), (402, "one two three"), (403, None), (404, " \n")]
    df = pd.DataFrame(texts, columns=["doc_id", "text"])
    got = near_dups.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).toPandas()
    want = brute.sql(oracles.NEAR_DUPS, documents=df)
    assert brute.rows(got) == brute.rows(want)


def test_pipeline_is_its_stages_by_brute_force(spark, docs, tokenizer):
    judged = brute.sql(oracles.QUALITY, documents=docs)
    left = docs[docs["doc_id"].isin(judged[judged["kept"]]["doc_id"])].copy()
    left["text"] = left["doc_id"].map(brute.line_dedup(pairs(left)))
    near = brute.sql(oracles.near_dups_sql(corpus_pipeline.NEAR), documents=left)
    left = left[left["doc_id"].isin(near[near["kept"]]["doc_id"])]
    targets = brute.sql(oracles.MIXING, documents=left).merge(left[["doc_id", "source"]], on="doc_id")
    takes = {s: math.floor(t + 0.5) for s, t in targets.groupby("source")["target"].max().items()}
    mixed = brute.mixed(list(left[["doc_id", "text", "source"]].itertuples(index=False, name=None)), takes)
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert keys(got) == brute.pieces(mixed, tokenizer)
    check_places(got)


def test_stages_return_documents(spark):
    frame = table(spark, SF, "documents").selectExpr("*", "doc_id as id", "'x' as row", "n_chars as size", "n_chars as n_words", "lang as key", "lang as kept", "lang as slot", "lang as target")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.dtypes == frame.dtypes and out.count() > 0
