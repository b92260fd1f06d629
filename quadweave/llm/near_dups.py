"""MinHash near-dedup with HyperMinHash registers.

Each shingle is hashed once; some bits choose the register, the leading zeros
and top mantissa bits of the rest are kept for the least hash of the register.
Registers that a short text leaves empty are filled from others.  Bands of
registers propose candidates, a collision-corrected estimate drops the hopeless
ones, and whole shingle sets decide.  Documents with equal sets are one class
from the start, however many they are.

A small bucket's pairs are all looked at.  A large bucket never emits its
pairs: all its members are compared with one of them, its centre ``c``, the
member whose buckets hold most rows.  Let ``D_x`` be the shingles that only one
of ``x`` and ``c`` has.  Two members are as far apart as ``D_x`` and ``D_y`` are,
and linked if that is at most ``d = (1 - threshold) / (1 + threshold) * (n_x + n_y)``.
Unless both are linked with ``c``, and so with each other's component, ``D_x`` and
``D_y`` then hold more than ``d`` shingles together and share one.  With each ``D``
in order, the group's rarest shingles first, the first one shared lies among the
first ``d / 2 + 1`` of the smaller ``D`` and the first ``d + 1`` of the other
(prefix filter), so that what most members have or lack alike tells nothing.
Members that meet so are the buckets of the next level, and so on; what is left
after the last level is compared pair by pair.  Nothing is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut
from ._words import Words, slices, texts_of, words_of

SHINGLE = 5
MANTISSA = 10
#: Links: ``100 * intersection >= threshold * union``; this one is the op10 query's.
THRESHOLD = 85
#: At the threshold a pair shares no band once in so many times; a band has the most rows with which all bands fit in so many registers.
MISSED, MOST_REGISTERS = 80_000, 360
#: Candidates pass whose estimate is within this many standard errors of the threshold.
ERRORS = 6.0
#: Pairs of different components for each member up to which a bucket's are all looked at, where a member is in a bucket
#: of every band, and at later levels; and the levels at which larger buckets have centres.
SMALL, SMALL_LATER, LEVELS = 4, 24, 3
#: Bits of a hash that choose its register, those that are ranked, and the other registers that an empty one looks at.
INDEX_BITS, RANK_BITS, PROBES = 20, 44, 32

_P = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.iinfo("uint64").max


class Bands(NamedTuple):
    bands: int
    rows: int

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def bands_for(threshold: int) -> Bands:
    """Bands that miss a pair at the threshold once in ``MISSED`` times; 36 of 8 rows at 85, 48 of 7 at 80."""
    s, found = threshold / 100, Bands(1, 1)
    if not 0 < s < 1:
        raise ValueError("the threshold is a percentage between 0 and 100")
    for rows in range(1, MOST_REGISTERS + 1):
        plan = Bands(math.ceil(math.log(MISSED) / -math.log1p(-(s**rows))), rows)
        if rows > 1 and plan.registers > MOST_REGISTERS:
            break
        found = plan
    return found


@lru_cache(maxsize=4)
def _fillers(registers: int) -> tuple[np.ndarray, np.ndarray]:
    """The registers that an empty one looks at in turn, and its own hash's salt should all be empty too."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, registers, (PROBES, registers)), rng.integers(0, 1 << 63, registers, dtype="uint64")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(words: Words, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes; of fewer words, the hash of all as one; of none, nothing."""
    per_word = np.array([xxhash.xxh3_64_intdigest(w) for w in words.distinct.to_pylist()], "uint64")
    h = per_word[words.codes] if words.codes.size else np.array([], "uint64")
    n = max(0, h.size - shingle + 1)
    rolled = np.zeros(n, "uint64")
    for k in range(shingle):
        rolled = rolled * _P + h[k : k + n]
    rolled = _mixed(rolled)
    for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        if b - a >= shingle:
            yield np.unique(rolled[a : b - shingle + 1])
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = one * _P + x
            yield _mixed(np.array([one], "uint64"))
        else:
            yield np.array([], "uint64")


def registers(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Leading zeros and mantissa of each register's least hash, ``(sets, n)`` unsigned 16-bit numbers.

    An empty register takes the value of the first that isn't of a fixed
    series of others; where all of those are empty, as in very short texts,
    the least of a hash of its own.  A set without shingles has zeros.
    """
    sizes = np.array([x.size for x in sets], "int64")
    hashes = np.concatenate([np.zeros(0, "uint64"), *sets])
    rank_mask = np.uint64((1 << RANK_BITS) - 1)
    low = np.full((sizes.size, n), _EMPTY, "uint64")
    place = ((hashes >> np.uint64(RANK_BITS)) * np.uint64(n)) >> np.uint64(INDEX_BITS)
    np.minimum.at(low.reshape(-1), np.repeat(np.arange(sizes.size), sizes) * n + place.astype("int64"), hashes & rank_mask)
    probes, salts = _fillers(n)
    filled = low.copy()
    row, col = np.nonzero((low == _EMPTY) & (sizes > 0)[:, None])
    for probe in probes:
        value = low[row, probe[col]]
        found = value != _EMPTY
        filled[row[found], col[found]] = value[found]
        row, col = row[~found], col[~found]
    for i in np.unique(row):
        own = col[row == i]
        for at in range(0, own.size, 64):
            salted = _mixed(sets[i][:, None] ^ salts[own[at : at + 64]][None, :]) & rank_mask
            filled[i, own[at : at + 64]] = salted.min(axis=0)
    filled[sizes == 0] = 0
    mantissa, exponent = np.frexp(filled.astype("float64"))
    lead = (RANK_BITS - exponent).astype("uint16")
    return (lead << np.uint16(MANTISSA)) | ((mantissa * 2 - 1) * (1 << MANTISSA)).clip(0, (1 << MANTISSA) - 1).astype("uint16")


#: Bounds of the leading-zero octaves, each in 16 parts within which the mantissas are as good as equally likely.
_PARTS = 16
_BOUNDS = np.concatenate([[2.0**-i * (1 - k / (2 * _PARTS)) for k in range(_PARTS)] for i in range(RANK_BITS)] + [[2.0**-RANK_BITS]])


def collisions(n: np.ndarray, m: np.ndarray, n_registers: int) -> np.ndarray:
    """Share of registers of sets of ``n`` and ``m`` shingles that are equal though the least hashes differ.

    The sum over all register values of the chance that either set's least
    hash has that value, for registers that aren't empty.
    """
    out = np.empty(n.size)
    for at in range(0, n.size, 2048):
        above = [np.exp(k[at : at + 2048, None] * np.log1p(-_BOUNDS / n_registers)[None, :]) for k in (n.astype("float64"), m.astype("float64"))]
        p, q = (np.diff(x, axis=1) / np.maximum(1 - x[:, :1], 1e-12) for x in above)
        out[at : at + 2048] = (p * q).sum(axis=1) * _PARTS / (1 << MANTISSA)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers ``(pairs, registers)``, less those equal by chance."""
    chance = collisions(n, m, a.shape[1])
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def signatures(docs: DataFrame, id_col: str, text_col: str, n_registers: int) -> DataFrame:
    """``(id, n, h1, h2, sig)``; ``h1, h2`` name the shingle set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text"):
                sets = list(shingle_sets(words_of(pc.ascii_lower(texts_of(batch.column("text"))))))
                n = [x.size for x in sets]
                h1 = [int(x.sum(dtype="uint64").astype("int64")) for x in sets]
                h2 = [int(_mixed(x ^ _P).sum(dtype="uint64").astype("int64")) for x in sets]
                sig = [row.tobytes() if x.size else None for x, row in zip(sets, registers(sets, n_registers), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, "int64"), pa.array(h1, "int64"), pa.array(h2, "int64"), pa.array(sig, "binary")], ["id", "n", "h1", "h2", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sign, "id long, n long, h1 long, h2 long, sig binary")


def _likely(pairs: DataFrame, reps: DataFrame, threshold: int, n_registers: int) -> DataFrame:
    """Pairs ``(a, b)`` whose estimated similarity may reach the threshold."""
    signed = pairs.join(reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), "a").join(reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b")), "b")
    sized = signed.filter((100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")))
    s = threshold / 100
    least = s - ERRORS * (s * (1 - s) / n_registers) ** 0.5

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "uint16").reshape(-1, n_registers) for c in ("sig_a", "sig_b"))
                good = estimate(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()) >= least
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return sized.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(keep, "a long, b long")


def _compared(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """``(a, b, n_a, linked, apart)`` by whole shingle sets; both texts meet row by row.

    ``apart`` are the shingles that only one of them has.
    """
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text_a", "text_b"):
                one = shingle_sets(words_of(pc.ascii_lower(texts_of(batch.column("text_a")))))
                two = shingle_sets(words_of(pc.ascii_lower(texts_of(batch.column("text_b")))))
                rows = []
                for x, y in zip(one, two, strict=True):
                    apart = np.setxor1d(x, y, assume_unique=True)
                    shared = (x.size + y.size - apart.size) // 2
                    linked = shared > 0 and 100 * shared >= threshold * (x.size + y.size - shared)
                    rows.append((x.size, linked, apart.astype("int64")))
                columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 3, ("int64", "bool", pa.list_(pa.int64())), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], ["a", "b", "n_a", "linked", "apart"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, n_a long, linked boolean, apart array<long>")


def _centres(large: DataFrame) -> DataFrame:
    """``(key, b)``: each bucket's centre, not always a member.

    A member's own choice is, of the members of its buckets, the one whose
    buckets hold most rows; a bucket's is what most of its members choose.  So
    the buckets in which a group of near copies lies have one centre, those
    that this centre itself isn't in too.
    """
    held = large.groupBy("id").agg(F.sum("n").alias("_held"))
    by_key = large.join(held, "id").groupBy("key").agg(F.max(F.struct("_held", (-F.col("id")).alias("_minus"))).alias("_top"))
    chosen = large.join(by_key, "key").groupBy("id").agg(F.max("_top").alias("_top"))
    votes = large.join(chosen, "id").groupBy("key", "_top").agg(F.count("*").alias("_votes"))
    return votes.groupBy("key").agg(F.max(F.struct("_votes", "_top")).alias("_most")).select("key", (-F.col("_most._top._minus")).alias("b"))


def _next_buckets(compared: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """``(key, id, low)``: which members compared with a centre may still be linked with each other.

    ``compared`` has the members as ``a`` and their centres as ``b``.  Of two
    members that may be linked, one at least is ``low`` in a bucket of both.
    """
    rows = compared.join(labels.withColumnRenamed("id", "a"), "a")
    open_ = rows.groupBy("b").agg(F.min("component").alias("_min"), F.max("component").alias("_max")).filter("_min <> _max").select("b")
    rows = rows.join(open_, "b", "left_semi")
    each = rows.select("b", "a", F.explode("apart").alias("shingle"))
    met = each.groupBy("b", "shingle").agg(F.count("*").alias("_rows")).filter("_rows > 1")
    # the shingles that no other member's D has come first, and lead nowhere
    ranked = each.join(met, ["b", "shingle"]).groupBy("b", "a").agg(F.sort_array(F.collect_list(F.struct("_rows", "shingle"))).alias("_met"))
    most = F.floor(F.col("n_a") * (100 - threshold) / threshold)  # how far a linked text can be
    ranked = ranked.join(rows.select("b", "a", "component", most.alias("_most"), F.size("apart").alias("_size")), ["b", "a"])
    before = F.col("_size") - F.size("_met")
    first = F.slice("_met", F.lit(1), F.greatest(F.lit(0), F.col("_most") + 1 - before).cast("int"))
    found = ranked.select("b", "a", "component", "_most", before.alias("_before"), F.posexplode(first).alias("_at", "_one"))
    low = F.col("_before") + F.col("_at") <= F.floor(F.col("_most") / 2)
    found = found.select(F.xxhash64("b", "_one.shingle").alias("key"), F.col("a").alias("id"), low.alias("low"), "component")
    open_ = found.groupBy("key").agg(F.min("component").alias("_min"), F.max("component").alias("_max"), F.max("low").alias("_low")).filter("_min <> _max and _low").select("key")
    return found.select("key", "id", "low").join(open_, "key", "left_semi").groupBy("key", "id").agg(F.max("low").alias("low"))


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of every linked id: smallest labels spread and jump until none changes."""
    edges = cut(links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        new = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("jumped"))
        new = cut(new.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("jumped", "component")).alias("component")))
        labels = new.select("id", "component")
        if not new.filter("old <> component").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per document.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.  A
    text with fewer than five words is one shingle; a null or blank text is
    empty and linked with nothing.  A null id is linked with nothing and kept,
    with a null component; rows that share an id are one document.
    ``threshold`` is the least similarity of a link in percent.
    """
    plan = bands_for(threshold)
    signed = cut(signatures(docs, id_col, text_col, plan.registers))
    classes = cut(signed.filter("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")))
    reps = classes.select(F.col("rep").alias("id"), "n", "sig")
    keys = F.explode(F.array(*(F.xxhash64(F.lit(b), F.substring("sig", 2 * plan.rows * b + 1, 2 * plan.rows)) for b in range(plan.bands))))
    bands = reps.select("id", keys.alias("key"))
    shared = bands.groupBy("key").agg(F.min("id").alias("_min"), F.max("id").alias("_max")).filter("_min <> _max")
    bands = cut(bands.join(shared.select("key"), "key", "left_semi").distinct().withColumn("low", F.lit(True)))
    near = cut(reps.join(bands.select("id").distinct(), "id", "left_semi"))
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = cut(wanted.join(near.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "text"]))
    n_near = near.count()

    labels = near.select("id", F.col("id").alias("component")).distinct()

    def settle(links: DataFrame) -> None:
        """Joins the components of linked documents."""
        nonlocal labels
        ends = links.join(labels.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
        ends = cut(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct())
        if ends.limit(1).count():
            joined = components(ends).select(F.col("id").alias("component"), F.col("component").alias("_to"))
            labels = cut(labels.join(joined, "component", "left").select("id", F.coalesce("_to", "component").alias("component")))

    for level in range(LEVELS + 1 if n_near else 0):
        placed = cut(bands.join(labels, "id"))
        within = placed.groupBy("key", "component").agg(F.count("*").alias("_n"), F.count_if(~F.col("low")).alias("_high"))
        crossing = lambda n: (F.sum(n) * F.sum(n) - F.sum(F.col(n) * F.col(n))) / 2
        sizes = within.groupBy("key").agg(F.sum("_n").alias("n"), (crossing("_n") - crossing("_high")).alias("_pairs")).filter("_pairs > 0")
        placed = cut(placed.join(sizes, "key"))
        few = (F.col("_pairs") <= (SMALL_LATER if level else SMALL) * F.col("n")) | F.lit(level == LEVELS)
        large, small = placed.filter(~few).select("key", "id", "n"), placed.filter(few).select("key", "id", "low")
        centres = cut(_centres(large)) if level < LEVELS else None
        some_large = centres is not None and centres.limit(1).count() > 0
        if some_large:
            pairs = cut(large.join(centres, "key").filter("id <> b").select(F.col("id").alias("a"), "b").distinct())
            compared = cut(_compared(pairs, texts, threshold))
            settle(compared.filter("linked").select("a", "b"))
        small = small.join(labels, "id")
        meet = small.select("key", F.col("id").alias("a"), F.col("low").alias("low_a"), F.col("component").alias("x")).join(small.select("key", F.col("id").alias("b"), F.col("low").alias("low_b"), F.col("component").alias("y")), "key")
        pairs = cut(meet.filter("a < b and x <> y and (low_a or low_b)").select("a", "b").distinct())
        settle(_compared(_likely(pairs, near, threshold, plan.registers), texts, threshold).filter("linked").select("a", "b"))
        if not some_large:
            break
        bands = cut(_next_buckets(compared, labels, threshold))

    found = classes.select("h1", "h2", "n", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("id", "n", "h1", "h2").join(found, ["h1", "h2", "n"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id."""
    name = "_gone"
    while name in docs.columns:
        name += "_"
    gone = near_duplicates(docs, id_col, text_col, threshold).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
