import hashlib

import public_tokenizers
import pytest

pytest.importorskip("quadweave.llm")
import corpus_pipeline
from quadweave.llm import chat, lines, mixing, near_dups, neighbours, packing, quality, substrings, token_counts, urls

TOKENIZER, VOCABULARY = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "the quick brown fox jumps over lazy dogs and runs home again " * 3000
CLASHING = "row string, id long, key string, kept string, size string, n_words string, slot string, start string, target string, taken string, text_b string, length string, piece string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
EMPTY = hashlib.sha256(b"").hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, *["c"], i, *["c"] * 11) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, blank and very long texts, repeated rows, ids that repeat."""
    return frame(spark, [(1, None, None), (2, "", "b"), (3, " \t\n", "a"), (4, LONG, "a"), (5, "same words here in two rows of it", "a"), (5, "same words here in two rows of it", "a"), (None, "a text without an id, but with words", None), (6, "😀 \u0000ok", "é")])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_packing(odd, none):
    assert packing.pack_documents(none, TOKENIZER).count() == 0
    got = packing.pack_documents(odd, TOKENIZER).toPandas()
    assert got.groupby(got["doc_id"].fillna(-1))["length"].sum()[[1.0, 2.0, 3.0]].tolist() == [1, 1, 1]
    assert (got["doc_id"] == 5).sum() == 2 and got["doc_id"].isna().sum() == 1
    assert got[got["doc_id"] == 4]["length"].max() == 4096


def test_substrings(odd, none):
    assert substrings.remove_repeats(none).count() == 0
    got = {r["doc_id"]: r for r in substrings.remove_repeats(odd).collect()}
    assert (got[1]["n_bytes"], got[1]["kept_sha256"], got[2]["n_spans"]) == (0, EMPTY, 0)
    assert got[4]["n_removed"] == got[4]["n_bytes"] == len(LONG) and got[5]["n_removed"] == 0


def test_neighbours(spark):
    schema = "vec_id long, embedding array<float>, label int, id long, list int, codes string, v string"
    make = lambda rows: spark.createDataFrame([(i, v, None, 1, 1, "c", "c") for i, v in rows], schema)
    assert neighbours.search(make([])).count() == 0
    got = neighbours.search(make([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 3.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (40, None)])).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 7, 0.0), (0, 4, 20, 0.0), (20, 1, 7, 3.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert neighbours.search(make([(0, [1.0, 0.0])])).count() == 0


def test_lines(odd, none):
    assert lines.drop_lines(none).count() == 0
    got = {r["row"]["doc_id"]: r for r in lines.drop_lines(odd).collect()}
    assert (got[1]["text"], got[1]["n_lines"]) == (None, 0) and (got[2]["text"], got[2]["n_lines"]) == ("", 1)
    assert got[3]["text"] == " \t\n" and got[4]["text"] == LONG and got[None]["n_dropped"] == 0


def test_token_counts(odd, none):
    assert token_counts.count_tokens(none, VOCABULARY).count() == 0
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.count_tokens(odd, VOCABULARY).collect()}
    assert got[1] == got[2] == (0, 0, 0) and got[3] == (0, 3, 0) and got[4][0] == 12 * 3000


def test_quality(odd, none):
    assert quality.judge(none).count() == 0
    judged = quality.judge(odd)
    assert len(set(judged.columns)) == len(judged.columns)
    got = {r["doc_id"]: r for r in judged.collect()}
    assert not got[1]["kept"] and got[1]["n_words"] == 0 and got[2]["base_failed"] and got[4]["base_failed"]
    assert judged.count() == odd.count()


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, root string, depth string, level string"
    make = lambda rows: spark.createDataFrame([(*r, "c", "c", "c") for r in rows], schema)
    assert chat.format_chat(make([])).count() == 0
    got = chat.format_chat(make([(1, 0, "User", "Hello there, friend!"), (1, 1, "assistant", "> hello THERE friend\n\nHi."), (1, 2, None, "> Hi.\n>> hello there friend\nAgain"), (1, 2, None, "> Hi.\n>> hello there friend\nAgain"), (1, 3, "user", None), (None, 4, "user", "> Hi."), (2, None, "user", "> Hi."), (1, 5, "user", "> never said")])).collect()
    links = {(r["conv_id"], r["turn"]): (r["reply_to"], r["root"], r["depth"]) for r in got}
    assert links[1, 1] == (0, 0, 1) and links[1, 2] == (1, 0, 2) and links[1, 3] == (None, 3, 0) and links[1, 5] == (None, 5, 0)
    assert len(got) == 8 and {r["content"] for r in got if r["turn"] == 2} == {"<|user|>\nAgain"}


def test_mixing(odd, none, spark):
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    got = mixing.mix(odd, keep=("doc_id",)).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["taken"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    whole = mixing.mixed_documents(odd)
    assert whole.columns == odd.columns
    sources = frame(spark, [(i, "w " * (1 + i % 7), ["a", "b", "c", None][i % 4 if i % 3 else 0]) for i in range(300)])
    rows = mixing.mix(sources).groupBy("row.source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 and r["max(target)"] <= 3 * r["max(source_size)"] for r in rows)


def test_urls(spark):
    schema = "page_id long, url string, html string, host string, path string, rule string, verdict string, _index string"
    make = lambda rows: spark.createDataFrame([(i, u, *["c"] * 6) for i, u in rows], schema)
    assert urls.judge(make([])).count() == 0
    cases = ["http://A.Example.NET/en/x?y", "https://example.net/de", "//x.net/", "http://sub.example.com/de/a#b", "http://example.com/dE/", "ftp://x.org/fr/", "http://x.org", "http://notnet/", "", None, "http://casino.example.com/", "http://u@net?q", "mailto:a", "x://"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(make(list(enumerate(cases)))).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1] == ("example.net", "/de", "net/", "block")
    assert got[2] == ("", "", None, "allow") and got[3] == ("sub.example.com", "/de/a", "example.com/de/", "block") and got[4][2] is None
    assert got[5][2:] == ("org/fr/", "allow") and got[7][2] is None and got[8] == got[9] == got[12] == ("", "", None, "allow")
    assert got[10][3] == "block" and got[13] == ("", "", None, "allow")


def test_near_duplicates(odd, none):
    assert near_dups.near_duplicates(none).count() == 0 and near_dups.drop_near_duplicates(none).count() == 0
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dups.near_duplicates(odd).collect()}
    assert got[1] == (0, 1, True) and got[3] == (0, 3, True) and got[None][1:] == (None, True) and got[4][1] == 4
    assert near_dups.drop_near_duplicates(odd).columns == odd.columns


def test_pipeline_stages(odd, none, spark):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "")
        assert out.count() >= 0 and (name == "best_fit_packing" or out.columns == odd.columns)
