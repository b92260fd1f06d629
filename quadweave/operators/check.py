"""Shapes as declarative checks: findings of ``(severity, message, focus, path)``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import quads as Q
from .. import vocab as V
from . import graph


@dataclass(frozen=True)
class Property:
    path: str
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    pattern: str | None = None
    iri_only: bool = False
    cls: str | None = None
    one_of: tuple[str, ...] = ()
    disjoint: str | None = None
    severity: str = "violation"
    message: str = ""


@dataclass(frozen=True)
class Shape:
    target_class: str | None = None
    target_objects_of: str | None = None
    properties: tuple[Property, ...] = ()
    closed: bool = False
    ignored: tuple[str, ...] = field(default=(V.RDF_TYPE,))


LEXICAL = {V.XSD_INTEGER: r"^[+-]?\d+$", V.XSD_DATE: r"^\d{4}-\d{2}-\d{2}$", V.XSD_DATETIME: r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", V.iri("xsd:decimal"): r"^[+-]?(\d+\.?\d*|\.\d+)$"}


def focus_nodes(quads: DataFrame, shape: Shape) -> DataFrame:
    if shape.target_class:
        return Q.instances(quads, shape.target_class).select(F.col("iri").alias("s"))
    return quads.filter(F.col("p") == shape.target_objects_of).select(F.col("o_value").alias("s")).distinct()


def _finding(df: DataFrame, severity: str, message: str, path: str) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.col("s").alias("focus"), F.lit(path).cast("string").alias("path")).distinct()


def _value_fault(p: Property) -> list[tuple[str, Column]]:
    faults = []
    if p.datatype:
        lexical = F.col("o_value").rlike(LEXICAL[p.datatype]) if p.datatype in LEXICAL else F.lit(True)
        faults.append(("datatype", (F.col("o_kind") == "iri") | (F.coalesce("o_datatype", F.lit(V.XSD_STRING)) != p.datatype) | ~lexical))
    if p.pattern:
        faults.append(("pattern", ~F.col("o_value").rlike(p.pattern)))
    if p.iri_only:
        faults.append(("nodeKind", F.col("o_kind") != "iri"))
    if p.one_of:
        faults.append(("in", ~F.col("o_value").isin(list(p.one_of))))
    return faults


def validate(quads: DataFrame, shapes: list[Shape]) -> DataFrame:
    """Findings of all shapes.  Counts and value tests of a shape share one pass over its focus nodes' triples."""
    found = []
    for shape in shapes:
        focus = focus_nodes(quads, shape)
        about = focus.join(quads, "s")
        if shape.closed:
            allowed = [p.path for p in shape.properties] + list(shape.ignored)
            extra = about.filter(~F.col("p").isin(allowed)).select("s", "p").distinct()
            found.append(extra.select(F.lit("violation").alias("severity"), F.lit("closed").alias("message"), F.col("s").alias("focus"), F.col("p").alias("path")))
        counted = [p for p in shape.properties if p.min_count is not None or p.max_count is not None]
        if counted:
            per = focus.join(quads.filter(F.col("p").isin([p.path for p in counted])).dropDuplicates(Q.COLUMNS), "s", "left").groupBy("s").agg(*(F.count_if(F.col("p") == p.path).alias(f"n{i}") for i, p in enumerate(counted)))
            for i, p in enumerate(counted):
                if p.min_count is not None:
                    found.append(_finding(per.filter(F.col(f"n{i}") < p.min_count), p.severity, p.message or "minCount", p.path))
                if p.max_count is not None:
                    found.append(_finding(per.filter(F.col(f"n{i}") > p.max_count), p.severity, p.message or "maxCount", p.path))
        for p in shape.properties:
            mine = about.filter(F.col("p") == p.path)
            found += [_finding(mine.filter(bad), p.severity, p.message or name, p.path) for name, bad in _value_fault(p)]
            if p.cls:
                typed = Q.instances(quads, p.cls).select(F.col("iri").alias("o_value"))
                found.append(_finding(mine.join(typed, "o_value", "left_anti"), p.severity, p.message or "class", p.path))
            if p.disjoint:
                other = about.filter(F.col("p") == p.disjoint).select("s", "o_value")
                found.append(_finding(mine.join(other, ["s", "o_value"], "left_semi"), p.severity, p.message or "disjoint", p.path))
    if not found:
        return quads.sparkSession.createDataFrame([], "severity string, message string, focus string, path string")
    return Q.combine(*found)


def taxonomy_findings(quads: DataFrame) -> DataFrame:
    """Cycles of ``broader`` and related concepts in one line of descent."""
    on_cycle = graph.cycles(graph.broader_edges(quads)).select(F.lit("violation").alias("severity"), F.lit("broader cycle").alias("message"), F.col("iri").alias("focus"), F.lit(V.BROADER).alias("path"))
    torn = graph.related_conflicts(quads).select(F.lit("violation").alias("severity"), F.lit("related to its ancestor").alias("message"), F.col("a").alias("focus"), F.lit(V.RELATED).alias("path"))
    return on_cycle.unionByName(torn)


def blame(quads: DataFrame, findings: DataFrame) -> DataFrame:
    """``(focus, doc)``: documents at most two steps in from each focus node, itself included."""
    docs = Q.instances(quads, V.DOCUMENT).select(F.col("iri").alias("doc"))
    back = Q.edges(quads).select(F.col("o").alias("at"), F.col("s").alias("doc")).distinct()
    zero = findings.select("focus").distinct().withColumn("doc", F.col("focus"))
    one = zero.withColumnRenamed("doc", "at").join(back, "at").select("focus", "doc")
    two = one.withColumnRenamed("doc", "at").join(back, "at").select("focus", "doc")
    part = zero.unionByName(one).unionByName(two).withColumn("doc", F.substring_index("doc", "#", 1)).distinct()
    return part.join(docs, "doc", "left_semi").select("focus", "doc")


def ordered(findings: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "violation", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return findings.orderBy(rank, "focus", F.coalesce("path", F.lit("")), "message")
