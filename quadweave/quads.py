"""The triple table: building, deduplicating and matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import RDF_TYPE, XSD_STRING, iri

COLUMNS = ["s", "p", "o_kind", "o_value", "o_datatype"]


def _col(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def link(df: DataFrame, s: Column, p: Column | str, o: Column | str) -> DataFrame:
    """Triples with an IRI object; rows with a null in any place give none."""
    return df.select(s.alias("s"), _col(p).alias("p"), F.lit("iri").alias("o_kind"), _col(o).alias("o_value"), F.lit(None).cast("string").alias("o_datatype")).dropna(subset=["s", "p", "o_value"])


def fact(df: DataFrame, s: Column, p: Column | str, value: Column, datatype: Column | str | None = None) -> DataFrame:
    """Triples with a literal object; ``xsd:string`` is left implicit."""
    kind = F.lit(None).cast("string") if datatype is None else F.when(_col(datatype) != XSD_STRING, _col(datatype))
    return df.select(s.alias("s"), _col(p).alias("p"), F.lit("literal").alias("o_kind"), value.cast("string").alias("o_value"), kind.alias("o_datatype")).dropna(subset=["s", "p", "o_value"])


def link_of(s: Column, p: Column | str, o: Column | str) -> Column:
    """A triple with an IRI object as a struct."""
    return F.struct(s.alias("s"), _col(p).alias("p"), F.lit("iri").alias("o_kind"), _col(o).alias("o_value"), F.lit(None).cast("string").alias("o_datatype"))


def fact_of(s: Column, p: Column | str, value: Column, datatype: Column | str | None = None) -> Column:
    """A triple with a literal object as a struct, as ``fact`` has it."""
    kind = F.lit(None).cast("string") if datatype is None else F.when(_col(datatype) != XSD_STRING, _col(datatype))
    return F.struct(s.alias("s"), _col(p).alias("p"), F.lit("literal").alias("o_kind"), value.cast("string").alias("o_value"), kind.alias("o_datatype"))


def facts(df: DataFrame, s: Column, values: dict[str, Column], links: dict[str, Column | str] | None = None) -> DataFrame:
    """Several triples per row in one pass over ``df``: an exploded array of structs, not a union of scans."""
    none = F.lit(None).cast("string")
    parts = [F.struct(F.lit(p).alias("p"), F.lit("literal").alias("o_kind"), v.cast("string").alias("o_value"), none.alias("o_datatype")) for p, v in values.items()]
    parts += [F.struct(F.lit(p).alias("p"), F.lit("iri").alias("o_kind"), _col(o).cast("string").alias("o_value"), none.alias("o_datatype")) for p, o in (links or {}).items()]
    return df.select(s.alias("s"), F.inline(F.array(*parts))).dropna(subset=["s", "o_value"]).select(COLUMNS)


def combine(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dedupe(quads: DataFrame) -> DataFrame:
    return quads.select(COLUMNS).dropDuplicates(COLUMNS)


def drop_xsd_string(quads: DataFrame) -> DataFrame:
    return quads.withColumn("o_datatype", F.when(F.col("o_datatype") != XSD_STRING, F.col("o_datatype")))


def match(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triple pattern; ``None`` matches anything, prefixed names are expanded, an object matches IRIs and literals alike."""
    for name, term in (("s", s), ("p", p), ("o_value", o)):
        if term is not None:
            quads = quads.filter(F.col(name) == iri(term))
    return quads.select(COLUMNS)


def ordered(quads: DataFrame) -> DataFrame:
    return quads.orderBy(COLUMNS)


def instances(quads: DataFrame, cls: str) -> DataFrame:
    return quads.filter((F.col("p") == RDF_TYPE) & (F.col("o_value") == iri(cls)) & (F.col("o_kind") == "iri")).select(F.col("s").alias("iri")).distinct()


def values(quads: DataFrame, p: str, name: str, literals: bool = True) -> DataFrame:
    """``(s, name)`` of one predicate."""
    rows = quads.filter(F.col("p") == iri(p))
    return (rows.filter("o_kind = 'literal'") if literals else rows).select("s", F.col("o_value").alias(name))


def first_literal(quads: DataFrame, p: str, name: str) -> DataFrame:
    """``(s, name)``: the smallest literal of each subject."""
    return values(quads, p, name).groupBy("s").agg(F.min(name).alias(name))


def edges(quads: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """``(s, p, o)`` between IRIs; types are no edges unless asked for."""
    rows = quads.filter("o_kind = 'iri'")
    rows = rows.filter(F.col("p").isin([iri(x) for x in predicates])) if predicates else rows.filter(F.col("p") != RDF_TYPE)
    return rows.select("s", "p", F.col("o_value").alias("o"))


def nodes(quads: DataFrame) -> DataFrame:
    return quads.select(F.col("s").alias("iri")).union(quads.filter("o_kind = 'iri'").select("o_value")).distinct()


def neighbours(quads: DataFrame, node: str, predicates: list[str] | None = None) -> DataFrame:
    """``(dir, p, iri)``, out before in."""
    e = edges(quads, predicates)
    out = e.filter(F.col("s") == node).select(F.lit("out").alias("dir"), "p", F.col("o").alias("iri"))
    into = e.filter(F.col("o") == node).select(F.lit("in").alias("dir"), "p", F.col("s").alias("iri"))
    return out.union(into).distinct()
