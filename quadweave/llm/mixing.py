"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, shuffled and joined, pass after pass, are a stream of
words that is cut into blocks of ``block_words``; its target tells how many
blocks the mix takes of it.  Points of a golden-ratio sequence are mapped,
by their rank among all points, through the sources' cumulative numbers of
blocks, so each slot of the mix gets a source, every stretch of the mix has
about the target shares, and each source as many slots as blocks.  Its slots,
ranked, hold its blocks in turn.  What the mix takes of a document is what lies
in blocks that have a slot.  All of it is DataFrame work: running sums and ranks
are taken within small buckets and added up over the buckets, so a source with
any share of the rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 4096
#: The golden-ratio sequence in 31 bits, so that products stay exact in 64.
PERIOD, STEP = 1 << 31, 1327217885
#: Slots ranked together.
SLOT_BUCKET = 1 << 16


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """``(_source, source_no, source_size, target, _take)``, one row per source.

    ``sized`` has ``_source`` and ``_size``.  Sources by code point, null last,
    take the weights in turn.  Targets share ``share`` of all words by weight;
    one above ``repeats`` times its source's size stops there and the excess
    is shared again, which is to fill a common level ``target / weight`` from
    the source with the smallest limit up.  One row per source is all that the
    windows here see.
    """
    by_source = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(F.col("_source").isNull(), "_source")
    number = F.row_number().over(ordered)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(number - 1, F.lit(len(weights))) + 1)
    rows = by_source.select("_source", "source_size", number.alias("source_no"), weight.alias("_weight"), F.sum("source_size").over(everything).alias("_total"))
    limit = F.col("source_size") * F.lit(float(repeats))
    rows = rows.withColumn("_level", limit / F.col("_weight"))
    up = everything.orderBy("_level", "source_no")
    filled = F.coalesce(F.sum(limit).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_common", (F.col("_total") * F.lit(float(share)) - filled) / open_weight)
    level = F.min(F.when(F.col("_level") > F.col("_common"), F.struct("_level", "source_no", "_common"))).over(everything)["_common"]
    rows = rows.withColumn("target", F.least(limit, F.coalesce(level, F.col("_level")) * F.col("_weight")))
    rows = rows.withColumn("_take", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * repeats).cast("long"))
    return rows.select("_source", "source_no", "source_size", "target", "_take")


def _numbered(rows: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column) -> DataFrame:
    """``rows`` with ``_start``: the sum of ``value`` over the rows before each one among those with its keys.

    ``bucket`` precedes ``order`` in the order.  A bucket's rows are summed up
    in one task, the buckets' sums in another.
    """
    sums = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_n"))
    over = Window.partitionBy(*keys).orderBy(bucket) if keys else Window.orderBy(bucket)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_b"), (F.sum("_n").over(over) - F.col("_n")).alias("_before"))
    within = F.sum(value).over(Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - value
    same = F.col(bucket) == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.withColumn("_within", within).join(sums, same)
    return joined.withColumn("_start", F.col("_before") + F.col("_within")).drop("_b", "_before", "_within", *(f"_k{i}" for i in range(len(keys))))


def _runs(rows: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row once for each number below ``n``, by way of runs of at most ``SLOT_BUCKET``."""
    rows = rows.withColumn("_count", n.cast("long")).filter("_count > 0")
    rows = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_count") - 1) / SLOT_BUCKET))))
    return rows.withColumn(name, F.explode(F.sequence(F.col("_run") * SLOT_BUCKET, F.least((F.col("_run") + 1) * SLOT_BUCKET, F.col("_count")) - 1))).drop("_count", "_run")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS, step: int = STEP) -> DataFrame:
    """``(source_no, block, slot)``: the place in the mix of each block that a source gives."""
    blocks = F.ceil(F.col("_take") / block_words)
    by_source = targets.select("source_no", blocks.alias("_blocks"))
    by_source = by_source.withColumn("_low", F.sum("_blocks").over(Window.orderBy("source_no")) - F.col("_blocks"))  # one row per source
    slots = by_source.agg(F.coalesce(F.sum("_blocks"), F.lit(0))).first()[0]  # one number
    if not slots:
        return targets.select("source_no", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot")).limit(0)
    point = (F.pmod(F.col("id"), F.lit(PERIOD)) * step) % PERIOD
    points = targets.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("_point"))
    points = points.withColumn("_part", F.floor(F.col("_point") * -(-slots // SLOT_BUCKET) / PERIOD))
    ranked = _numbered(points, [], "_part", ["_point", "slot"], F.lit(1).cast("long")).select("slot", F.col("_start").alias("_rank"))
    owners = _runs(by_source, F.col("_blocks"), "_own").select("source_no", (F.col("_low") + F.col("_own")).alias("_rank"))
    hits = owners.join(ranked, "_rank").select("source_no", "slot", F.floor(F.col("slot") / SLOT_BUCKET).alias("_part"))
    return _numbered(hits, ["source_no"], "_part", ["slot"], F.lit(1).cast("long")).select("source_no", F.col("_start").alias("block"), "slot")


def _streams(rows: DataFrame, **named: object) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their place in their source's stream, and the sources' targets.

    ``rows`` has ``_source, _size, _order, _id, _tie``; added are ``_start``,
    ``source_no``, ``source_size``, ``target`` and ``_take``.
    """
    targets = cut(source_targets(rows.select("_source", "_size"), **named))
    placed = _numbered(rows.withColumn("_bucket", F.substring("_order", 1, 3)), ["_source"], "_bucket", ["_order", "_id", "_size", "_tie"], F.col("_size"))
    placed = placed.join(targets.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_bucket")
    return placed, targets


def _keys(source: str, id_col: str, text: Column, seed: str) -> list[Column]:
    """What streams are built from: sources, words, and an order that reruns repeat."""
    mixed_up = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return [F.col(source).alias("_source"), word_count(text.cast("string")).alias("_size"), mixed_up.alias("_order"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_tie")]


def _occurrences(placed: DataFrame) -> DataFrame:
    """A row for each time that a document begins before its source's cut, with ``_at``, its place in the stream."""
    passes = F.ceil(F.col("_take") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    rows = placed.filter("_size > 0 and _take > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    return rows.withColumn("_at", F.col("_start") + F.col("_pass") * F.col("source_size")).filter("_at < _take")


def mix(docs: DataFrame, source: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: str = "mix", keep: tuple[str, ...] | None = None, **named: object) -> DataFrame:
    """Rows of ``docs`` with ``size, source_size, target, taken, start, slot``.

    ``taken`` counts the words the mix takes, repeats included: those that lie
    in blocks with a slot, up to the source's target.  ``slot`` is the place of
    the block that the document begins in, null if nothing of it is taken.
    Order within a source is by a hash of the id, then id, size and text hash,
    so that reruns agree.  A null text has size 0; a null source is a source of
    its own; a table without words takes nothing; repeated rows are documents
    of their own.  ``keep`` names the columns to carry besides; by default all,
    as the struct ``row``.
    """
    block, step = named.pop("block_words", BLOCK_WORDS), named.pop("step", STEP)
    names = [f"_c{i}" for i in range(len(keep))] if keep is not None else ["row"]
    carried = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)] if keep is not None else [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")]
    rows = cut(docs.select(F.monotonically_increasing_id().alias("_rid"), *carried, *_keys(source, id_col, F.col(text_col), seed)))
    placed, targets = _streams(rows.drop(*names), **named)
    placed = cut(placed.select("_rid", "_size", "_start", "source_no", "source_size", "target", "_take"))
    parts = _occurrences(placed).withColumn("_end", F.least(F.col("_at") + F.col("_size"), F.col("_take")))
    parts = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_end") - 1) / block))))
    words = F.least("_end", (F.col("block") + 1) * block) - F.greatest("_at", F.col("block") * block)
    taken = parts.select("_rid", "source_no", "block", words.alias("_words")).join(schedule(targets, block, step), ["source_no", "block"])
    taken = taken.groupBy("_rid").agg(F.sum("_words").alias("taken"), F.min_by("slot", "block").alias("slot"))
    out = rows.select("_rid", *names).join(placed, "_rid").join(taken, "_rid", "left")
    shown = [F.col(n).alias(c) for n, c in zip(names, keep if keep is not None else names, strict=True)]
    return out.select(*shown, F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("_start").alias("start"), "slot")


def mixed_documents(docs: DataFrame, source: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: str = "mix", slot_col: str | None = None, **named: object) -> DataFrame:
    """The mix itself, in the order of its slots: whole documents, each as often as the mix takes it.

    A document over its source's cut is taken if at least half of it lies
    before, so a source's words come within half a document of its target.  One
    that has no words is kept once: it costs the mix nothing.  ``slot_col``
    names a column for the slot, if one is wanted.  Nulls, repeated rows and
    empty tables are as in :func:`mix`.
    """
    block, step = named.pop("block_words", BLOCK_WORDS), named.pop("step", STEP)
    base = cut(docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))
    fields = base.select("_rid", *(F.col(f"row.`{c}`").alias(n) for c, n in ((source, "_f0"), (id_col, "_f1"), (text_col, "_f2"))))
    placed, targets = _streams(cut(fields.select("_rid", *_keys("_f0", "_f1", F.col("_f2"), seed))), **named)
    placed = cut(placed.select("_rid", "_size", "_start", "source_no", "source_size", "_take"))
    often = _occurrences(placed).filter("2 * (_take - _at) >= _size").select("_rid", "source_no", "_at")
    wordless = placed.filter("_size = 0").select("_rid", "source_no", F.least("_start", F.greatest(F.col("_take") - 1, F.lit(0))).alias("_at"))
    often = often.unionByName(wordless).withColumn("block", F.floor(F.col("_at") / block))
    often = cut(often.join(schedule(targets, block, step), ["source_no", "block"], "left").select("_rid", "slot", "_at"))
    # a third of the rows may be wordless and share one slot
    rows = base.join(often, "_rid").repartitionByRange("slot", "_at", "_rid").sortWithinPartitions("slot", "_at", "_rid")
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), *([F.col("slot").alias(slot_col)] if slot_col else []))
