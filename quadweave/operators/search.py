"""Lexical, vector and hybrid search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..vocab import UNDETERMINED

BOOSTS = {"title": 3.0, "labels": 2.0, "description": 1.5, "text": 1.0}
K1, B = 1.2, 0.75
RRF_K = 60


def limit_of(limit: int | None, default: int = 10) -> int:
    return limit if isinstance(limit, int) and not isinstance(limit, bool) and limit >= 0 else default


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25(entries: DataFrame, query: str, fields: dict[str, float] | None = None, limit: int | None = None, prefix: bool = False, fuzzy: float = 0.0) -> DataFrame:
    """``(id, score)``: BM25 (k1 1.2, b 0.75) summed over boosted fields, best first, ties by id.

    Only query terms are exploded; with ``prefix`` a word that begins with a
    term counts too, with ``fuzzy`` one within that share of its length.
    """
    fields = fields or {k: v for k, v in BOOSTS.items() if k in entries.columns}
    asked = list(dict.fromkeys(t for t in "".join(c if c.isalnum() else " " for c in query.lower()).split()))
    if not asked:
        return entries.select("id", F.lit(0.0).alias("score")).limit(0)
    parts = F.array(*(F.struct(F.lit(k).alias("field"), F.lit(float(w)).alias("boost"), terms(F.col(k)).alias("words")) for k, w in fields.items()))
    rows = entries.select("id", F.inline(parts))
    size = rows.select("id", "field", "boost", F.size("words").alias("len"), "words")

    def hit(word: Column, term: str) -> Column:
        test = word == term
        if prefix:
            test = test | word.startswith(term)
        if fuzzy:
            most = max(1, round(fuzzy * len(term)))
            test = test | (F.levenshtein(word, F.lit(term), most) >= 0)
        return test

    def times(term: str) -> Column:
        return F.size(F.filter("words", lambda word: hit(word, term)))

    counts = F.array(*(F.struct(F.lit(t).alias("term"), times(t).alias("tf")) for t in asked))
    average = size.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    tf = size.select("id", "field", "boost", "len", F.inline(counts)).filter("tf > 0")
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    scored = tf.join(df, ["field", "term"]).join(average, "field")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    out = scored.groupBy("id").agg(F.sum(F.col("boost") * idf * norm).alias("score"))
    return out.orderBy(F.desc(F.round("score", 9)), "id").limit(limit_of(limit))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """To unit length; a zero vector as it is."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(v.cast("array<double>"))


def vector_top(vectors: DataFrame, query: list[float], limit: int | None = None, min_score: float = 0.0, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``(id, score)`` by cosine, in double precision.  Negative scores are dropped by the default floor."""
    length = math.sqrt(sum(float(x) ** 2 for x in query)) or 1.0
    q = F.array(*(F.lit(float(x) / length) for x in query))
    scored = vectors.select(F.col(id_col).alias("id"), dot(normalised(F.col(vector_col)), q).alias("score")).filter(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), "id").limit(limit_of(limit))


def rrf(rankings: dict[str, DataFrame], k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """``(id, score, via)`` from rankings ``(id, rank)``; ``via`` is the one leg, or ``hybrid``."""
    rows = None
    for name, ranking in rankings.items():
        leg = ranking.select("id", F.col("rank").cast("long").alias("rank"), F.lit(name).alias("leg"))
        rows = leg if rows is None else rows.unionByName(leg)
    fused = rows.groupBy("id").agg(F.sum(F.lit(1.0) / (F.col("rank") + k)).alias("score"), F.when(F.count_distinct("leg") > 1, "hybrid").otherwise(F.min("leg")).alias("via"))
    fused = fused.orderBy(F.desc(F.round("score", 12)), "id")
    return fused if limit is None else fused.limit(limit_of(limit))


def as_ranking(results: DataFrame) -> DataFrame:
    """Ranks a bounded result by score, then id."""
    return results.select("id", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")).alias("rank"))


def hybrid(entries: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], limit: int | None = None, **named: object) -> DataFrame:
    n = limit_of(limit)
    return rrf({"lexical": as_ranking(bm25(entries, query, limit=n, **named)), "vector": as_ranking(vector_top(vectors, query_vector, n))}, limit=n)


def by_language(entries: DataFrame) -> DataFrame:
    """Entries under their language, ``und`` without one; concepts under every language."""
    known = entries.select(F.coalesce("language", F.lit(UNDETERMINED)).alias("l"), "type").filter("type <> 'Concept'").select("l").distinct()
    listed = sorted(r["l"] for r in known.collect())  # the corpus's languages
    every = F.array(*map(F.lit, listed or [UNDETERMINED]))
    return entries.withColumn("language", F.explode(F.when(F.col("type") == "Concept", every).otherwise(F.array(F.coalesce("language", F.lit(UNDETERMINED))))))


def embed_text(*fields: Column) -> Column:
    return F.concat_ws("\n\n", *(F.nullif(f, F.lit("")) for f in fields))


def mock_vector(text: Column, dims: int = 8) -> Column:
    """A deterministic vector in [-1, 1) from hashes of the text, for tests without a model."""
    return F.array(*((F.pmod(F.xxhash64(text, F.lit(i)), F.lit(1 << 20)) / (1 << 19) - 1).cast("float") for i in range(dims)))


class IndexMismatch(ValueError):
    """A vector index does not fit what is asked of it."""


def check_index(index: dict, expected: dict) -> None:
    """Refuses the first of model, dtype, dims and source digest that differs."""
    for name in ("model", "dtype", "dims", "source"):
        if name in expected and index.get(name) != expected[name]:
            raise IndexMismatch(f"{name}: {index.get(name)!r}, not {expected[name]!r}")
