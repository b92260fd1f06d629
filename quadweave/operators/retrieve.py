"""Sections of Markdown, and budgeted context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.markdown import Slugger


def heading_lines(docs: DataFrame) -> DataFrame:
    """``(doc, line, text, fenced, level, title)`` of each line; headings inside code fences are none.

    A backtick fence has no backtick after its mark; a fence that isn't closed
    runs to the end.
    """
    rows = docs.select("doc", F.posexplode(F.split("content", r"\r?\n")).alias("line", "text"))
    mark = F.regexp_extract("text", r"^ {0,3}(?:(`{3,})(?=[^`]*$)|~{3,})", 0)
    marks = rows.withColumn("mark", F.trim(mark)).filter("mark <> ''").select("doc", "line", "mark", F.col("text").rlike(r"^ {0,3}[`~]+\s*$").alias("bare"))
    # only fence marks are folded, one document's at a time, to the spans of lines that they enclose
    start = F.struct(F.lit("").alias("fence"), F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def fold(a: Column, x: Column) -> Column:
        opens, closes = a["fence"] == "", (a["fence"] != "") & x["mark"].startswith(a["fence"]) & x["bare"]
        return F.struct(
            F.when(opens, x["mark"]).when(closes, F.lit("")).otherwise(a["fence"]).alias("fence"), F.when(opens, x["line"]).otherwise(a["at"]).alias("at"),
            F.when(closes, F.concat(a["spans"], F.array(F.struct(a["at"].alias("a"), x["line"].alias("b"))))).otherwise(a["spans"]).alias("spans"),
        )

    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("line", "mark", "bare"))), start, fold)
    ends = F.array(F.struct(F.col("r.at").alias("a"), F.lit(2**31 - 1).alias("b")))
    spans = marks.groupBy("doc").agg(folded.alias("r")).select("doc", F.explode(F.when(F.col("r.fence") != "", F.concat("r.spans", ends)).otherwise(F.col("r.spans"))).alias("span")).select("doc", "span.*")
    by_line = Window.partitionBy("doc").orderBy("line")
    edges = spans.select("doc", F.col("a").alias("line"), F.col("b").alias("until"))
    reach = F.max("until").over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(edges, ["doc", "line"], "left").withColumn("until", reach).select("doc", "line", "text", F.coalesce(F.col("line") <= F.col("until"), F.lit(False)).alias("fenced"))
    heading = F.regexp_extract("text", r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", 1)
    level = F.when(~F.col("fenced") & (heading != ""), F.length(heading))
    title = F.when(level.isNotNull(), F.trim(F.regexp_extract("text", r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", 2)))
    return rows.select("*", level.alias("level"), title.alias("title"))


def sections(docs: DataFrame) -> DataFrame:
    """``(doc, line, level, title, slug, occurrence, own_end, subtree_end, own_text, subtree_text)`` per heading of ``docs(doc, content)``.

    Repeated slugs of a document get ``-1``, ``-2``...; ``occurrence`` counts
    headings of the same title (without case) and level from 0.
    """
    heads = heading_lines(docs).filter("level is not null").select("doc", "line", "level", "title")
    by_doc = Window.partitionBy("doc").orderBy("line")
    occurrence = F.row_number().over(Window.partitionBy("doc", F.lower("title"), "level").orderBy("line")) - 1
    # a subtree ends at the next heading of its level or a lower one: the nearest of the next ones of each level
    ends = F.least(*(F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("line"))).over(by_doc.rowsBetween(1, Window.unboundedFollowing))) for k in range(1, 7)))
    heads = heads.select("*", occurrence.cast("int").alias("occurrence"), F.lead("line").over(by_doc).alias("own_end"), ends.alias("subtree_end"))
    heads = heads.join(slugs(heads), ["doc", "line"])
    texts = docs.select("doc", F.split("content", r"\r?\n").alias("lines"))
    piece = lambda a, b: F.trim(F.array_join(F.slice(F.col("lines"), a + 1, F.greatest(F.coalesce(b, F.size("lines")) - a, F.lit(0))), "\n"), F.lit("\n "))
    return heads.join(texts, "doc").select("doc", "line", "level", "title", "slug", "occurrence", "own_end", "subtree_end", piece(F.col("line") + 1, F.col("own_end")).alias("own_text"), piece(F.col("line"), F.col("subtree_end")).alias("subtree_text"))


def slugs(heads: DataFrame) -> DataFrame:
    """``(doc, line, slug)`` of ``heads(doc, line, title)``, told apart as the parser does: a slug that was given before gets ``-1``, ``-2``..."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for titles in batch["titles"]:
                slugger = Slugger()
                out.append([slugger.slug(t) for t in titles])
            yield pd.DataFrame({"doc": batch["doc"], "lines": batch["lines"], "slugs": out})

    of = F.array_sort(F.collect_list(F.struct("line", "title")))
    rows = heads.groupBy("doc").agg(of.alias("h")).select("doc", F.col("h.line").alias("lines"), F.col("h.title").alias("titles"))
    kind = heads.schema["doc"].dataType.simpleString()
    made = rows.mapInPandas(run, f"doc {kind}, lines array<int>, slugs array<string>")
    return made.select("doc", F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("slugs").alias("slug"))))


def preamble(docs: DataFrame) -> DataFrame:
    """``(doc, text)`` before the first heading."""
    first = heading_lines(docs).filter("level is not null").groupBy("doc").agg(F.min("line").alias("first"))
    lines = docs.select("doc", F.split("content", r"\r?\n").alias("lines")).join(first, "doc", "left")
    return lines.select("doc", F.trim(F.array_join(F.slice("lines", F.lit(1), F.coalesce("first", F.size("lines"))), "\n"), F.lit("\n ")).alias("text"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def assemble(blocks: DataFrame, max_chars: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Blocks that fit a budget, greedily in order: one too long is skipped and later, shorter ones still fit.

    ``blocks(key..., seq, iri, content)`` gives per key ``(iris, used,
    truncated, refusal, context)``; no blocks at all is ``no-route`` for the
    caller to report, blocks without content are ``no-content``.
    """
    key = key or []
    size = F.coalesce(utf16_length(F.col("content")), F.lit(0))
    items = F.array_sort(F.collect_list(F.struct("seq", "iri", F.coalesce("content", F.lit("")).alias("content"), size.alias("n"))))
    zero = F.struct(F.lit(0).alias("used"), F.lit(False).alias("cut"), F.array().cast("array<struct<iri:string,content:string>>").alias("kept"))

    def fold(a: Column, x: Column) -> Column:
        fits = F.lit(True) if max_chars is None else a["used"] + x["n"] <= max_chars
        take = (x["n"] > 0) & fits
        return F.struct(
            F.when(take, a["used"] + x["n"]).otherwise(a["used"]).alias("used"),
            (a["cut"] | ((x["n"] > 0) & ~fits)).alias("cut"),
            F.when(take, F.concat(a["kept"], F.array(F.struct(x["iri"].alias("iri"), x["content"].alias("content"))))).otherwise(a["kept"]).alias("kept"),
        )

    rows = blocks.groupBy(*key).agg(F.aggregate(items, zero, fold).alias("r"))
    kept = F.col("r.kept")
    return rows.select(*key, F.array_join(F.transform(kept, lambda x: x["iri"]), ",").alias("iris"), F.col("r.used").alias("used"), F.col("r.cut").alias("truncated"), F.when((F.size(kept) == 0) & ~F.col("r.cut"), F.lit("no-content")).alias("refusal"), F.array_join(F.transform(kept, lambda x: x["content"]), "\n\n").alias("context"))
