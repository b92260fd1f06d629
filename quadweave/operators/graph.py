"""Traversal, closure and components: driver loops of joins over edges."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import quads as Q
from .. import vocab as V
from ..store import cut


class Traversal(NamedTuple):
    """``nodes(iri, depth, rank)``, ``hops(depth, s, p, o, dir)`` and ``exclusions(iri, rule)``."""

    nodes: DataFrame
    hops: DataFrame
    exclusions: DataFrame


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """``(at, dir, p, to)``; out before in."""
    out = edges.select(F.col("s").alias("at"), F.lit(0).alias("dir"), "p", F.col("o").alias("to"))
    into = edges.select(F.col("o").alias("at"), F.lit(1).alias("dir"), "p", F.col("s").alias("to"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def traverse(quads: DataFrame, seeds: DataFrame, depth: int = 1, direction: str = "out", predicates: list[str] | None = None, excluded: DataFrame | None = None, limit: int | None = None) -> Traversal:
    """Breadth-first from ``seeds(iri)``, each node at its least depth.

    Within a level nodes are ranked by their first discovery: the parent's
    rank, then direction, predicate and IRI.  Hops are recorded before the
    visited and scope checks, so back-edges show.  An excluded node
    (``excluded(iri, rule)``) is met and recorded but neither kept nor
    expanded; an excluded seed expands all the same.  ``limit`` counts kept
    nodes beyond the seeds; without one, nodes have no rank.
    """
    spark = quads.sparkSession
    moves = cut(steps(Q.edges(quads, predicates).distinct(), direction))
    if excluded is None:
        excluded = spark.createDataFrame([], "iri string, rule string")
    # without a limit nobody needs a level's ranks: parents are told apart by their IRIs then, and no level meets in one task
    rank = (lambda df, *by: df.withColumn("rank", F.row_number().over(Window.orderBy(*by)))) if limit is not None else (lambda df, *by: df.withColumn("rank", F.lit(None).cast("int")))
    frontier = cut(rank(seeds.select("iri").distinct(), "iri"))
    seen = frontier.select("iri")
    kept = frontier.join(excluded, "iri", "left_anti").select("iri", F.lit(0).alias("depth"), "rank")
    hops, met = None, frontier.join(excluded, "iri").select("iri", "rule")
    room = limit
    for level in range(1, depth + 1):
        found = cut(frontier.join(moves, F.col("iri") == F.col("at")).select("rank", "dir", "p", "at", "to"))
        hop = found.select(F.lit(level).alias("depth"), F.when(F.col("dir") == 0, F.col("at")).otherwise(F.col("to")).alias("s"), "p", F.when(F.col("dir") == 0, F.col("to")).otherwise(F.col("at")).alias("o"), F.element_at(F.array(F.lit("out"), F.lit("in")), F.col("dir") + 1).alias("dir"))
        hops = hop if hops is None else hops.unionByName(hop)
        new = found.groupBy(F.col("to").alias("iri")).agg(F.min(F.struct("rank", "dir", "p")).alias("via")).join(seen, "iri", "left_anti")
        new = cut(new.join(excluded.withColumnRenamed("rule", "why"), "iri", "left"))
        met = met.unionByName(new.filter("why is not null").select("iri", F.col("why").alias("rule")))
        fresh = rank(new.filter("why is null"), "via.rank", "via.dir", "via.p", "iri").select("iri", "rank")
        if room is not None:
            fresh = fresh.filter(F.col("rank") <= room)
        frontier = cut(fresh)
        n = frontier.count()
        if room is not None:
            room -= n
        kept = kept.unionByName(frontier.select("iri", F.lit(level).alias("depth"), "rank"))
        seen = seen.union(new.select("iri"))
        if not n or room == 0:
            break
    hops = hops if hops is not None else spark.createDataFrame([], "depth int, s string, p string, o string, dir string")
    return Traversal(kept, hops.distinct(), met.distinct())


def reverse_references(quads: DataFrame, node: str, **named: object) -> DataFrame:
    one = quads.sparkSession.createDataFrame([(node,)], "iri string")
    return traverse(quads, one, 1, "in", [V.REFERENCES], **named).nodes.filter("depth > 0")


def impact(quads: DataFrame, node: str, depth: int = 3, **named: object) -> DataFrame:
    """Nodes that reach ``node``, the seed left out."""
    one = quads.sparkSession.createDataFrame([(node,)], "iri string")
    return traverse(quads, one, depth, "in", **named).nodes.filter("depth > 0")


def broader_edges(quads: DataFrame) -> DataFrame:
    """``(child, parent)`` from ``broader`` and inverted ``narrower``."""
    up = quads.filter((F.col("p") == V.BROADER) & (F.col("o_kind") == "iri")).select(F.col("s").alias("child"), F.col("o_value").alias("parent"))
    down = quads.filter((F.col("p") == V.NARROWER) & (F.col("o_kind") == "iri")).select(F.col("o_value").alias("child"), F.col("s").alias("parent"))
    return up.union(down).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """All ``(child, parent)`` pairs joined by a path, by joining the newest pairs with the edges until none is new.

    Meant for taxonomies: the result can be the square of the nodes.
    """
    edges = cut(edges.select("child", "parent").distinct())
    total = newest = edges
    step = edges.select(F.col("child").alias("parent"), F.col("parent").alias("next"))
    while True:
        newest = cut(newest.join(step, "parent").select("child", F.col("next").alias("parent")).distinct().join(total, ["child", "parent"], "left_anti"))
        if not newest.limit(1).count():
            return total
        total = cut(total.unionByName(newest))


def cycles(edges: DataFrame) -> DataFrame:
    """``(iri, component)`` of nodes on cycles: mutually reachable, the component named by its smallest node.

    Nodes without an edge in or out are trimmed until none is left to trim.
    Then colours spread forwards, the smallest name winning; the nodes of a
    colour that reach its name backwards are its component, and the others go
    another round.  A name that none of them points to lies between cycles and
    on none.  No pairs of reachable nodes are built.
    """
    e = cut(edges.select("child", "parent").filter("child is not null and parent is not null").distinct())
    done = []
    while True:
        before = -1
        while (n := e.count()) != before:
            before = n
            inner = e.select(F.col("child").alias("iri")).intersect(e.select("parent"))
            e = cut(e.join(inner.withColumnRenamed("iri", "child"), "child", "left_semi").join(inner.withColumnRenamed("iri", "parent"), "parent", "left_semi").select("child", "parent"))
        if not n:
            break
        colour = cut(e.select(F.col("child").alias("iri")).union(e.select("parent")).distinct().withColumn("colour", F.col("iri")))
        while True:
            came = e.join(colour, F.col("child") == F.col("iri")).groupBy(F.col("parent").alias("iri")).agg(F.min("colour").alias("came"))
            new = cut(colour.join(came, "iri", "left").select("iri", F.least("colour", F.coalesce("came", "colour")).alias("colour"), (F.col("came") < F.col("colour")).alias("moved")))
            colour = new.select("iri", "colour")
            if not new.filter("moved").limit(1).count():
                break
        same = cut(e.join(colour.select(F.col("iri").alias("child"), F.col("colour").alias("c")), "child").join(colour.select(F.col("iri").alias("parent"), F.col("colour").alias("d")), "parent").filter("c = d").select("child", "parent", "c"))
        found = front = cut(colour.filter("iri = colour"))
        while front.limit(1).count():
            front = cut(same.join(front.select(F.col("iri").alias("parent")), "parent").select(F.col("child").alias("iri"), F.col("c").alias("colour")).distinct().join(found, "iri", "left_anti"))
            found = cut(found.unionByName(front))
        named = same.filter("parent = c").select(F.col("parent").alias("iri"), F.col("c").alias("component")).distinct()
        done.append(cut(found.filter("iri <> colour").select("iri", F.col("colour").alias("component")).unionByName(named)))
        gone = found.select("iri")
        e = cut(e.join(gone.withColumnRenamed("iri", "child"), "child", "left_anti").join(gone.withColumnRenamed("iri", "parent"), "parent", "left_anti"))
    if not done:
        return edges.sparkSession.createDataFrame([], "iri string, component string")
    return Q.combine(*done)


def related_conflicts(quads: DataFrame) -> DataFrame:
    """``(a, b)``: related concepts of which one is a broader ancestor of the other by more than one step."""
    rel = quads.filter((F.col("p") == V.RELATED) & (F.col("o_kind") == "iri")).select(F.least("s", "o_value").alias("a"), F.greatest("s", "o_value").alias("b")).filter("a <> b").distinct()
    e = cut(broader_edges(quads))
    # ancestors of the related concepts only, not of all
    ends = rel.select(F.explode(F.array("a", "b")).alias("start")).distinct()
    reached = front = cut(ends.join(e, F.col("start") == F.col("child")).select("start", F.col("parent").alias("at")).distinct())
    direct = reached
    while front.limit(1).count():
        front = cut(front.join(e, F.col("at") == F.col("child")).select("start", F.col("parent").alias("at")).distinct().join(reached, ["start", "at"], "left_anti"))
        reached = cut(reached.unionByName(front))
    both = lambda x: x.select(F.least("start", "at").alias("a"), F.greatest("start", "at").alias("b")).distinct()
    return rel.join(both(reached), ["a", "b"], "left_semi").join(both(direct), ["a", "b"], "left_anti")
