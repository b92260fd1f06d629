"""Triples from the relational tables: keys become edges, rows become nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import quads as Q
from .. import vocab as V

BASE = "urn:kg:"


def node(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{BASE}{kind}/"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, titles and foreign keys of the star schema; an order references the parts of its lines.

    Two lines of one part give a triple twice: readers tell triples apart themselves.
    """
    t = lambda name: read(spark, sf_dir, name)
    parts = [
        Q.facts(t("region"), node("region", "r_regionkey"), {V.TITLE: F.col("r_name")}, {V.RDF_TYPE: V.NS + "Region"}),
        Q.facts(t("nation"), node("nation", "n_nationkey"), {V.TITLE: F.col("n_name")}, {V.RDF_TYPE: V.NS + "Nation", V.REFERENCES: node("region", "n_regionkey")}),
        Q.facts(t("customer"), node("customer", "c_custkey"), {V.TITLE: F.col("c_name"), V.SUBJECT: F.col("c_mktsegment")}, {V.RDF_TYPE: V.NS + "Customer", V.REFERENCES: node("nation", "c_nationkey")}),
        Q.facts(t("supplier"), node("supplier", "s_suppkey"), {V.TITLE: F.col("s_name")}, {V.RDF_TYPE: V.NS + "Supplier", V.REFERENCES: node("nation", "s_nationkey")}),
        Q.facts(t("part"), node("part", "p_partkey"), {V.TITLE: F.col("p_name"), V.SUBJECT: F.col("p_type")}, {V.RDF_TYPE: V.NS + "Part"}),
        Q.facts(t("orders"), node("order", "o_orderkey"), {V.SUBJECT: F.col("o_orderpriority")}, {V.RDF_TYPE: V.NS + "Order", V.SOURCE: node("customer", "o_custkey")}),
        Q.link(t("lineitem").select("l_orderkey", "l_partkey"), node("order", "l_orderkey"), V.REFERENCES, node("part", "l_partkey")),
    ]
    return Q.combine(*parts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, language, source, hash, title (the first line) and applicability of documents; other languages translate."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    d = node("doc", "doc_id")
    base = Q.facts(
        docs, d,
        {V.LANGUAGE: F.col("lang"), V.SOURCE: F.col("source"), V.CONTENT_HASH: F.sha2("text", 256), V.TITLE: F.nullif(F.substring_index("text", "\n", 1), F.lit(""))},
        {V.RDF_TYPE: V.DOCUMENT},
    )
    scope = Q.facts(labels, d, {}, {V.APPLIES_TO: F.when(F.col("quality") == 1, node("variant", F.lit("high"))).otherwise(node("variant", F.lit("low"))), V.NOT_APPLIES_TO: F.when(F.col("toxic") == 1, node("variant", F.lit("high")))})
    return Q.combine(base, scope, translations(docs))


def translations(docs: DataFrame) -> DataFrame:
    """A document in another language translates the largest smaller English id, found by a two-level running maximum."""
    rows = docs.select("doc_id", "lang", F.floor(F.col("doc_id") / 65536).alias("_b"))
    english = F.max(F.when(F.col("lang") == "en", F.col("doc_id")))
    per = rows.groupBy("_b").agg(english.alias("_m"))
    before = per.select("_b", F.max("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    near = english.over(Window.partitionBy("_b").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn("_near", near).join(before, "_b").withColumn("_of", F.coalesce("_near", "_before")).filter("lang <> 'en' and _of is not null")
    return Q.combine(
        Q.link(found, node("doc", "doc_id"), V.TRANSLATION_OF, node("doc", "_of")),
        Q.link(found, node("doc", "_of"), V.HAS_TRANSLATION, node("doc", "doc_id")),
    )


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept scheme over all parts: a tree of four children each, inverse links, small cycles and associative links."""
    keys = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    c, up = node("concept", "k"), F.floor(F.col("k") / 4).cast("long")
    return Q.combine(
        Q.link(keys, c, V.RDF_TYPE, V.CONCEPT),
        Q.fact(keys, c, V.PREF_LABEL, F.concat(F.lit("Concept "), F.col("k"))),
        Q.link(keys.filter("k > 0 and k % 2 = 0"), c, V.BROADER, node("concept", up)),
        Q.link(keys.filter("k > 0 and k % 2 = 1"), node("concept", up), V.NARROWER, c),
        Q.link(keys.filter("k > 0 and k % 97 = 0"), node("concept", up), V.BROADER, c),
        Q.link(keys.filter("k % 5 = 0"), c, V.RELATED, node("concept", F.floor(F.col("k") / 16).cast("long"))),
        Q.link(keys.filter("k % 7 = 0"), c, V.RELATED, node("concept", F.col("k") * 3 + 1)),
    )
