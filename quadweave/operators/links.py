"""Link targets resolved to files of the corpus by one equi-join on candidate keys."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

EXTENSIONS, INDEX_FILES = (".md", ".mdx"), ("index", "README")
_EXTENSION = r"(\.[A-Za-z0-9]+)$"
_NONE = "array<string>"


class Route(NamedTuple):
    """Site paths under ``base_path`` are files under ``root``."""

    base_path: str
    root: str = ""
    language: str | None = None
    extensions: tuple[str, ...] = EXTENSIONS
    index_files: tuple[str, ...] = INDEX_FILES


def _has_extension(target: Column) -> Column:
    return (target != "") & target.rlike(_EXTENSION)


def _for_documents(target: Column, extensions: Sequence[str]) -> Column:
    """Whether a target may be a document: it has no extension, or one of theirs; an empty list says nothing."""
    if not extensions:
        return F.lit(True)
    return ~_has_extension(target) | F.lower(F.regexp_extract(target, _EXTENSION, 1)).isin([e.lower() for e in extensions])


def candidates(target: Column, folder: Column, extensions: Sequence[str] = EXTENSIONS, index_files: Sequence[str] = INDEX_FILES) -> Column:
    """Paths a target may mean, best first: itself with an extension; a folder's index files first for a folder, else last."""
    plain = F.when(target == "", F.array().cast(_NONE)).otherwise(F.array(*(F.concat(target, F.lit(e)) for e in extensions)).cast(_NONE))
    inside = F.when(target == "", F.lit("")).otherwise(F.concat(target, F.lit("/")))
    index = F.array(*(F.concat(inside, F.lit(i + e)) for i in index_files for e in extensions)).cast(_NONE)
    return F.when(_has_extension(target), F.array(target)).when(folder, F.concat(index, plain)).otherwise(F.concat(plain, index))


def _tiers(path: Column) -> Column:
    return F.array(F.concat(F.lit("e:"), path), F.concat(F.lit("l:"), F.lower(path)), F.concat(F.lit("s:"), S.slug_norm(path)))


def _keys(paths: Column) -> Column:
    return F.flatten(F.transform(paths, _tiers))


def resolve(links: DataFrame, paths: DataFrame, routes: Sequence[Route] = ()) -> DataFrame:
    """``(path, raw, kind, resolved, anchor, url)`` for each distinct ``links(path, raw)`` that addresses something.

    Kinds are ``external``, ``internal`` and ``broken``.  Each candidate is
    tried exactly, without case, then without case, dashes and underscores; a
    looser form that several files share resolves to none of them.  Anchors in
    the same document, site paths without a route and files that are no
    documents are left out.
    """
    rows = links.select("path", "raw").distinct()
    outside = rows.filter(S.has_scheme("raw")).select("path", "raw", F.lit("external").alias("kind"), F.lit(None).cast("string").alias("resolved"), F.lit(None).cast("string").alias("anchor"), S.external_url("raw").alias("url"))
    target, anchor = S.fragment_split("raw")
    inner = rows.filter(~S.has_scheme("raw")).select("path", "raw", target.alias("target"), F.nullif(anchor, F.lit("")).alias("anchor")).filter("target <> ''")

    site = F.col("target").startswith("/")
    # columns of their own: each is used in many places
    inner = inner.withColumn("decoded", S.safe_decode("target")).withColumn("clean", F.regexp_replace("decoded", "/+$", "")).withColumn("at", S.relative_path("path", F.col("decoded")))
    clean = F.col("clean")
    folder = F.col("target").endswith("/")
    routed, any_route = F.array().cast(_NONE), F.lit(False)
    for r in routes:
        rest = F.regexp_replace(F.substr(clean, F.lit(len(r.base_path) + 1)), "^/+", "")
        fits = ((clean == r.base_path) | clean.startswith(r.base_path + "/")) & _for_documents(rest, r.extensions)
        stem = F.when(rest == "", F.lit(r.root)).otherwise(F.concat(F.lit(r.root + "/" if r.root else ""), rest))
        routed = F.concat(routed, F.when(fits, _keys(candidates(stem, folder | (rest == ""), r.extensions, r.index_files))).otherwise(F.array().cast(_NONE)))
        any_route = any_route | fits
    at = F.col("at")
    near = F.when(at.isNull(), F.array().cast(_NONE)).otherwise(F.concat(F.array(F.concat(F.lit("e:"), at)), F.when(_has_extension(at), F.array().cast(_NONE)).otherwise(_keys(candidates(at, folder)))))
    skip = F.when(site, ~any_route).otherwise(F.coalesce(~_for_documents(at, EXTENSIONS), F.lit(False)))
    inner = inner.select("path", "raw", "anchor", skip.alias("skip"), F.when(site, routed).otherwise(near).alias("keys"))

    lookup = paths.select("path").distinct().select(F.explode(_tiers(F.col("path"))).alias("key"), F.col("path").alias("hit")).groupBy("key").agg(F.min("hit").alias("hit"), F.count("*").alias("n")).filter("n = 1").select("key", "hit")
    tried = inner.select("path", "raw", F.posexplode("keys").alias("pos", "key"))
    best = tried.join(lookup, "key").groupBy("path", "raw").agg(F.min_by("hit", "pos").alias("resolved"))
    found = inner.drop("keys").join(best, ["path", "raw"], "left").filter("resolved is not null or not skip")
    kind = F.when(F.col("resolved").isNotNull(), "internal").otherwise("broken")
    return outside.unionByName(found.select("path", "raw", kind.alias("kind"), "resolved", F.when(F.col("resolved").isNotNull(), F.col("anchor")).alias("anchor"), F.lit(None).cast("string").alias("url")))


def route_language(path: Column, routes: Sequence[Route]) -> Column:
    """The language of the longest root that holds the path and declares one."""
    out = F.lit(None).cast("string")
    for r in sorted((r for r in routes if r.language is not None), key=lambda r: len(r.root)):
        out = F.when((path == r.root) | path.startswith(r.root + "/") | F.lit(r.root == ""), F.lit(r.language)).otherwise(out)
    return out
