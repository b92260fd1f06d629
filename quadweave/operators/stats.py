"""Graph health and coverage as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import quads as Q
from .. import vocab as V
from ..functions.scalars import half_up


def counts(quads: DataFrame) -> DataFrame:
    """One row: ``triples, documents, sections, concepts, references``."""
    typed = lambda cls: F.count_if((F.col("p") == V.RDF_TYPE) & (F.col("o_value") == cls))
    return quads.agg(F.count("*").alias("triples"), typed(V.DOCUMENT).alias("documents"), typed(V.SECTION).alias("sections"), typed(V.CONCEPT).alias("concepts"), F.count_if(F.col("p") == V.REFERENCES).alias("references"))


def degrees(quads: DataFrame, cls: str = V.DOCUMENT) -> DataFrame:
    """``(iri, degree)`` of every instance: a reference counts for its source and, if another, for its target; fragments don't."""
    refs = quads.filter((F.col("p") == V.REFERENCES) & (F.col("o_kind") == "iri")).select("s", "o_value").distinct()
    a, b = F.substring_index("s", "#", 1), F.substring_index("o_value", "#", 1)
    ends = refs.select(F.explode(F.array_distinct(F.array(a, b))).alias("iri")).groupBy("iri").agg(F.count("*").alias("n"))
    return Q.instances(quads, cls).join(ends, "iri", "left").select("iri", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def orphans(quads: DataFrame, cls: str = V.DOCUMENT) -> DataFrame:
    return degrees(quads, cls).filter("degree = 0").select("iri")


def most_connected(quads: DataFrame, cls: str = V.DOCUMENT, top: int = 5) -> DataFrame:
    return degrees(quads, cls).filter("degree > 0").orderBy(F.desc("degree"), "iri").limit(top)


def coverage(quads: DataFrame, cls: str = V.DOCUMENT, fields: dict[str, str] | None = None, by: DataFrame | None = None) -> DataFrame:
    """``([group,] field, ord, covered, total, ratio, pct)``; one pass whatever the fields; an empty corpus is fully covered.

    ``by`` is ``(iri, group)``.
    """
    fields = fields or V.COVERAGE
    subjects = Q.instances(quads, cls)
    if by is not None:
        subjects = subjects.join(by, "iri")
    keys = ["group"] if by is not None else []
    carried = quads.filter(F.col("p").isin(list(fields.values()))).select(F.col("s").alias("iri"), "p").distinct()
    per = subjects.join(carried, "iri").groupBy(*keys, "p").agg(F.count("*").alias("covered"))
    totals = subjects.groupBy(*keys).agg(F.count("*").alias("total"))
    names = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("field"), F.lit(v).alias("p")) for i, (k, v) in enumerate(fields.items()))))
    rows = totals.select("*", names.alias("f")).select(*keys, "total", "f.*").join(per, [*keys, "p"], "left")
    covered = F.coalesce("covered", F.lit(0)).cast("long")
    ratio = F.when(F.col("total") > 0, covered / F.col("total") * 100).otherwise(100.0)
    return rows.select(*keys, "field", "ord", covered.alias("covered"), "total", ratio.alias("ratio"), half_up(ratio, 1).alias("pct"))


def below(covered: DataFrame, thresholds: dict[str, float] | None = None, uniform: float | None = None) -> DataFrame:
    """Fields whose unrounded ratio misses the threshold; a uniform one overrides the map."""
    if uniform is not None:
        return covered.withColumn("threshold", F.lit(float(uniform))).filter("ratio < threshold")
    pairs = [x for k, v in (thresholds or {}).items() for x in (F.lit(k), F.lit(float(v)))]
    if not pairs:
        return covered.withColumn("threshold", F.lit(0.0)).limit(0)
    return covered.withColumn("threshold", F.create_map(*pairs)[F.col("field")]).filter("ratio < threshold")


def languages(quads: DataFrame) -> DataFrame:
    """``(iri, group)``: each document's language, the smallest if it has several."""
    return Q.first_literal(quads, V.LANGUAGE, "group").withColumnRenamed("s", "iri")


def untranslated(quads: DataFrame, source_language: str = "en") -> DataFrame:
    """``(iri, language)``: documents of the source language times the other languages, less the translations there are."""
    langs = Q.instances(quads, V.DOCUMENT).join(languages(quads), "iri")
    others = langs.filter(F.col("group") != source_language).select(F.col("group").alias("language")).distinct()
    listed = others.agg(F.collect_set("language").alias("languages"))  # one value per language of the corpus
    listed = F.array(*(F.lit(x) for x in sorted(listed.first()["languages"]))).cast("array<string>")
    wanted = langs.filter(F.col("group") == source_language).select("iri", F.explode(listed).alias("language"))
    done = quads.filter(F.col("p") == V.TRANSLATION_OF).select(F.col("s").alias("t"), F.col("o_value").alias("iri")).join(langs.select(F.col("iri").alias("t"), F.col("group").alias("language")), "t").select("iri", "language").distinct()
    return wanted.join(done, ["iri", "language"], "left_anti")


def broken(quads: DataFrame) -> DataFrame:
    """``(path, kind, target)`` of links and section keys that lead nowhere."""
    rows = quads.filter(F.col("p").isin([V.BROKEN_LINK, V.BROKEN_SECTION])).select("s", F.when(F.col("p") == V.BROKEN_LINK, "link").otherwise("section").alias("kind"), F.col("o_value").alias("target"))
    paths = Q.first_literal(quads, V.PATH, "path")
    return rows.join(paths, "s", "left").select(F.coalesce("path", "s").alias("path"), "kind", "target")


def appearance(events: DataFrame, key: str, item: str, time: str, seq: str) -> DataFrame:
    """``(key, first, last, items)``: bounds by time and the items in order of first appearance."""
    firsts = events.groupBy(key, item).agg(F.min(F.struct(time, seq)).alias("_at"), F.max(time).alias("_last"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(item).alias("_item")))), lambda x: x["_item"])
    return firsts.groupBy(key).agg(F.min(F.col("_at")[time]).alias("first"), F.max("_last").alias("last"), F.array_join(ordered, ",").alias("items"))


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
