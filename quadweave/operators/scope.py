"""Applicability: which nodes a scope excludes, and by which rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V


class UnknownScope(ValueError):
    """A scope names a variant or subject that the graph has not."""


def resolve_variant(quads: DataFrame, text: str) -> str:
    """A node's IRI as given, else a node by title, else by the last part of its IRI, both without case; refuses otherwise."""
    low = text.lower()
    title = (F.col("p") == V.TITLE) & (F.lower("o_value") == low) & (F.col("o_kind") == "literal")
    found = quads.agg(
        F.min(F.when((F.col("s") == text) | ((F.col("o_value") == text) & (F.col("o_kind") == "iri")), F.lit(text))).alias("a"),
        F.min(F.when(title, F.col("s"))).alias("b"),
        F.min(F.when(F.lower(F.regexp_extract("s", r"([^/#:]+)$", 1)) == low, F.col("s"))).alias("c"),
        F.min(F.when((F.col("o_kind") == "iri") & (F.lower(F.regexp_extract("o_value", r"([^/#:]+)$", 1)) == low), F.col("o_value"))).alias("d"),
    ).first()
    for value in found:
        if value is not None:
            return value
    raise UnknownScope(f"no node for {text!r}")


def exclusions(quads: DataFrame, variant: str | None = None, subject: str | None = None, language: str | None = None) -> DataFrame:
    """``(iri, rule)`` of the subjects that the scope leaves out.

    An explicit negative excludes; so does a positive set without the target;
    no claim keeps.  Variant, subject, language are tried in that order and the
    first that excludes is the rule.  A section takes its document's language.
    """
    claims = quads.filter(F.col("p").isin([V.APPLIES_TO, V.NOT_APPLIES_TO, V.ASPECT, V.NOT_ASPECT, V.LANGUAGE]))

    def claim(yes: str, no: str | None, target: str | None) -> list:
        if target is None:
            return [F.lit(False)] * 2
        negative = F.bool_or((F.col("p") == no) & (F.col("o_value") == target)) if no else F.lit(False)
        missing = F.bool_or(F.col("p") == yes) & ~F.coalesce(F.bool_or((F.col("p") == yes) & (F.col("o_value") == target)), F.lit(False))
        return [F.coalesce(negative, F.lit(False)), F.coalesce(missing, F.lit(False))]

    v, s = claim(V.APPLIES_TO, V.NOT_APPLIES_TO, variant), claim(V.ASPECT, V.NOT_ASPECT, subject)
    rules = claims.groupBy("s").agg(v[0].alias("vn"), v[1].alias("vm"), s[0].alias("sn"), s[1].alias("sm"), F.min(F.when(F.col("p") == V.LANGUAGE, F.col("o_value"))).alias("lang"))
    if language is not None:
        subjects = quads.select("s").distinct().withColumn("doc", F.substring_index("s", "#", 1))
        langs = rules.filter("lang is not null").select(F.col("s").alias("doc"), F.col("lang").alias("doc_lang"))
        rules = subjects.join(rules, "s", "left").join(langs, "doc", "left").withColumn("lang", F.coalesce("lang", "doc_lang"))
        other = F.col("lang").isNotNull() & (F.col("lang") != language)
    else:
        other = F.lit(False)
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    rule = F.when(on("vn"), "variant-negative").when(on("vm"), "variant-not-listed").when(on("sn"), "subject-negative").when(on("sm"), "subject-not-listed").when(other, "language")
    return rules.select(F.col("s").alias("iri"), rule.alias("rule")).filter("rule is not null")
