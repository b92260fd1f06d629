"""Suffix-array dedup of repeated byte strings, across documents and within one.

Sorting every suffix of a corpus would move it hundreds of times over, so only
suffixes that can matter are sorted.  Each window of ``length`` bytes has an
anchor, its leftmost smallest hash of ``GRAM`` bytes; equal windows have equal
anchors in equal places, so a window whose anchor is found once is unique.  The
others bring, per anchor, the bytes that its windows span.  Among the contexts
of one anchor, the suffixes from the anchor on and the reversed prefixes before
it are put in order by deep-shallow sorting: multikey passes to a shallow depth,
then blind tries, built level by level, for groups that are still equal.  The
common-prefix lengths of neighbours then tell, for each offset of a window from
its anchor, which contexts hold the same window, without comparing pairs.
Equality is decided on bytes.

An anchor with more contexts than one task should hold is split by what its
windows have in common, over ever fewer offsets, down to single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut
from ._words import slices

LENGTH, GRAM = 400, 64
#: Contexts that one task sorts together, about, and the most that one anchor may bring there.
TASK_ROWS, GROUP_ROWS = 15_000, 15_000
#: Offsets kept together at each further split of a large anchor.
SPLITS = (48, 7, 1)
#: Bytes up to which the multikey passes sort.
SHALLOW = 96

_INDEX_BITS = 28
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random byte values, and powers of the base and of its inverse, for ``n`` bytes."""
    if not _powers or _powers[1].size < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        powers = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, "uint64")
            steps[0] = 1
            powers.append(np.multiply.accumulate(steps))
        _powers[:] = [np.random.default_rng(5).integers(1, 1 << 63, 256, dtype="uint64"), *powers]
    return tuple(_powers)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(hash, position, first window, last window)`` of each anchor of a text of at least ``length`` bytes."""
    values, powers, inverses = _tables(data.size)
    total = np.concatenate([np.zeros(1, "uint64"), np.cumsum(values[data] * powers[: data.size], dtype="uint64")])
    h = _mixed((total[gram:] - total[:-gram]) * inverses[: data.size - gram + 1])
    low = np.uint64((1 << _INDEX_BITS) - 1)
    key = (h & ~low) | np.arange(h.size, dtype="uint64")
    w = length - gram + 1
    padded = np.full(-(-h.size // w) * w, np.iinfo("uint64").max, "uint64")
    padded[: h.size] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = data.size - length + 1
    at = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & low).astype("int64")
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, n - 1]
    position = at[first]
    return h[position].astype("int64"), position, first, last


def deep_shallow(groups: np.ndarray, rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows within groups, and each row's common prefix with the row before it (-1 at a group's first).

    ``rows`` is ``(n, width)`` with a width in whole words of eight bytes.
    """
    n, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype("uint64").reshape(n, width // 8)
    order = np.argsort(groups, kind="stable")
    g = groups[order]
    fresh = np.r_[True, g[1:] != g[:-1]] if n else np.zeros(0, bool)

    def live() -> tuple[np.ndarray, np.ndarray]:
        """Places in the order that share a segment with others, and their segments."""
        segment = np.cumsum(fresh) - 1
        busy = (np.bincount(segment, minlength=1) > 1)[segment] if n else np.zeros(0, bool)
        at = np.flatnonzero(busy)
        return at, segment[at]

    # multikey passes, a word at a time, over segments that are equal so far
    for j in range(min(shallow, width) // 8):
        at, segment = live()
        if not at.size:
            break
        key = words[order[at], j]
        by = np.lexsort((key, segment))
        order[at], key = order[at][by], key[by]
        fresh[at[1:]] |= (key[1:] != key[:-1]) & (segment[1:] == segment[:-1])

    # blind tries, a level at a time: skip to where a segment branches, branch on that byte alone
    done = np.zeros(n, bool)
    while True:
        at, segment = live()
        keep = ~done[order[at]]
        at, segment = at[keep], segment[keep]
        if not at.size:
            break
        start = np.r_[True, segment[1:] != segment[:-1]]
        head = order[at[np.maximum.accumulate(np.where(start, np.arange(at.size), 0))]]
        depth = common(rows, order[at], head)
        first = np.flatnonzero(start)
        skip = np.minimum.reduceat(depth, first)
        skip = np.repeat(skip, np.diff(np.r_[first, at.size]))
        equal = skip >= width
        done[order[at[equal]]] = True
        at, segment, skip = at[~equal], segment[~equal], skip[~equal]
        byte = rows[order[at], skip]
        by = np.lexsort((byte, segment))
        order[at], byte = order[at][by], byte[by]
        fresh[at[1:]] |= (byte[1:] != byte[:-1]) & (segment[1:] == segment[:-1])

    lcp = np.full(n, -1, "int64")
    g = groups[order]
    inner = np.flatnonzero(g[1:] == g[:-1]) + 1 if n else np.zeros(0, "int64")
    lcp[inner] = common(rows, order[inner], order[inner - 1])
    return order, lcp


def common(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows ``a`` and ``b``."""
    out = np.empty(a.size, "int64")
    for at in range(0, a.size, 8192):
        differ = rows[a[at : at + 8192]] != rows[b[at : at + 8192]]
        first = differ.argmax(axis=1)
        out[at : at + 8192] = np.where(differ[np.arange(len(differ)), first], first, rows.shape[1])
    return out


def repeated_offsets(groups: np.ndarray, right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """For each offset the rows whose window at it another row of the group holds at the same offset.

    ``right`` are the bytes from the anchor on, ``left`` those before it
    backwards, zero-padded; row ``i`` has windows at the offsets from
    ``low[i]`` to ``high[i]``.
    """
    r_order, r_lcp = deep_shallow(groups, right)
    l_order, l_lcp = deep_shallow(groups, left)
    n = groups.size
    r_class, l_class = np.empty(n, "int64"), np.empty(n, "int64")
    for d in range(int(low.min()), int(high.max()) + 1):
        mine = np.flatnonzero((low <= d) & (d <= high))
        if mine.size < 2:
            continue
        r_class[r_order] = np.cumsum(r_lcp < length - d)
        l_class[l_order] = np.cumsum(l_lcp < d)
        key = r_class[mine] * (n + 1) + l_class[mine]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(mine.size, bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        if twice.any():
            yield d, mine[twice]


def _runs(row: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive offsets per row: row, smallest, largest."""
    by = np.lexsort((offset, row))
    row, offset = row[by], offset[by]
    start = np.r_[True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)] if row.size else np.zeros(0, bool)
    first = np.flatnonzero(start)
    return row[first], offset[first], offset[np.r_[first[1:] - 1, row.size - 1]] if row.size else offset


def _sorted_out(length: int):  # noqa: ANN202
    def sort(batch: pd.DataFrame) -> pd.DataFrame:
        n = len(batch)
        groups = pd.factorize(batch["gk"])[0].astype("int64")
        position, first, last = (batch[c].to_numpy("int64") for c in ("position", "first", "last"))
        low, high = position - last, position - first
        wide = -(-length // 8) * 8
        right, left = np.zeros((n, wide), "uint8"), np.zeros((n, wide), "uint8")
        for i, data in enumerate(batch["bytes"]):
            data = np.frombuffer(data, "uint8")
            cut_at = position[i] - first[i]
            if cut_at < 0:  # the anchor lies before the windows left to decide; cannot be
                raise ValueError("a window begins after its anchor")
            right[i, : min(length, data.size - cut_at)] = data[cut_at : cut_at + length]
            left[i, :cut_at] = data[:cut_at][::-1]
        rows, offsets = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
        for d, found in repeated_offsets(groups, right, left, low, high, length) if n else ():
            rows.append(found)
            offsets.append(np.full(found.size, d))
        row, least, most = _runs(np.concatenate(rows), np.concatenate(offsets))
        return pd.DataFrame({"key": batch["key"].to_numpy()[row], "begin": position[row] - most, "end": position[row] - least + length})

    return sort


def _split(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """Contexts per block of ``width`` offsets, under a key of the bytes all windows of the block share."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gk", "key", "position", "first", "last", "bytes"]
        for batch in batches:
            rows = []
            for gk, key, position, first, last, data in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                low, high = position - last, position - first
                for block in range(low // width, high // width + 1):
                    d0, d1 = block * width, block * width + width - 1
                    a, b = position - min(d1, high), position - max(d0, low)  # first and last window here
                    # what every window of the block holds, so that a context that owns any of them can tell it
                    core = data[position - d0 - first : position - d1 + length - first]
                    name = hashlib.blake2b(gk + b"%d|" % block + core, digest_size=16).digest()
                    rows.append((name, key, position, a, b, data[a - first : b + length - first]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, ("binary", "binary", "int64", "int64", "int64", "binary"), strict=True)], names)

    return contexts.mapInArrow(split, contexts.schema)


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(key, begin, end)``: byte spans of distinct ``texts`` ``(key binary, text)`` made of repeated windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text"):
                out: list[list] = [[], [], [], [], []]
                keys = batch.column("key")
                for i, text in enumerate(batch.column("text").to_pylist()):
                    found = anchors(np.frombuffer(text.encode(), "uint8"), length)
                    for column, values in zip(out, (np.full(found[0].size, i), *found), strict=True):
                        column.append(values)
                row, *rest = (np.concatenate([np.zeros(0, "int64"), *c]) for c in out)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), *map(pa.array, rest)], ["key", "anchor", "position", "first", "last"])

    found = cut(texts.mapInArrow(find, "key binary, anchor long, position long, first long, last long"))
    name = F.xxhash64("key", "position")
    twice = found.groupBy("anchor").agg(F.min(name).alias("_min"), F.max(name).alias("_max")).filter("_min <> _max").select("anchor")
    wanted = found.join(twice, "anchor", "left_semi").groupBy("key").agg(F.collect_list(F.struct("anchor", "position", "first", "last")).alias("at"))

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gk", "key", "position", "first", "last", "bytes"]
        for batch in slices(batches, "text"):
            rows = []
            for key, text, at in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True):
                data = text.encode()
                for x in at:
                    rows.append((x["anchor"].to_bytes(8, "little", signed=True), key, x["position"], x["first"], x["last"], data[x["first"] : x["last"] + length]))
                if len(rows) > 20_000:
                    yield _batch(rows, names)
                    rows = []
            yield _batch(rows, names)

    def _batch(rows: list, names: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, ("binary", "binary", "int64", "int64", "int64", "binary"), strict=True)], names)

    schema = "gk binary, key binary, position long, first long, last long, bytes binary"
    contexts = cut(texts.join(wanted, "key").select("key", "text", "at").mapInArrow(bring, schema))

    spans = None
    small_parts, whole = [], []
    for width in (*SPLITS, None):
        sizes = contexts.groupBy("gk").agg(F.count("*").alias("n"))
        large = cut(sizes.filter(F.col("n") > GROUP_ROWS).select("gk"))  # at most rows / GROUP_ROWS keys
        if not large.limit(1).count():
            small_parts.append(contexts)
            break
        if width is None:  # single windows: equal keys are equal windows
            whole.append(contexts.join(large, "gk", "left_semi"))
            small_parts.append(contexts.join(large, "gk", "left_anti"))
            break
        small_parts.append(contexts.join(large, "gk", "left_anti"))
        parts = _split(contexts.join(large, "gk", "left_semi"), width, length)
        contexts = cut(parts)
        more = contexts.groupBy("gk").agg(F.count("*").alias("n")).filter("n > 1").select("gk")
        contexts = contexts.join(more, "gk", "left_semi")
    for part in small_parts:
        rows = part.count()
        bucket = F.pmod(F.xxhash64("gk"), F.lit(max(1, -(-rows // TASK_ROWS))))
        got = part.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_sorted_out(length), "key binary, begin long, end long")
        spans = got if spans is None else spans.unionByName(got)
    for part in whole:
        spans = spans.unionByName(part.select("key", F.col("first").alias("begin"), (F.col("last") + length).alias("end")))
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])``, one row per document.

    Removes each byte that a string of ``length`` bytes covers which also
    starts anywhere else; strings are judged on the input.  Each distinct text
    is worked on once; one that several rows hold is removed whole if it is
    long enough.  A null text is empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    sha, n_bytes = F.sha2("text", 256), F.octet_length("text")
    key = F.substring(F.unhex(sha), 1, 16)
    texts = cut(rows.filter(n_bytes >= length).groupBy(key.alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("copies")))
    spans = repeated_spans(texts.select("key", "text"), length)
    by_text = spans.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    empty = hashlib.sha256(b"").hexdigest()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for key_, text_, spans_ in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, kept, at, n_removed, n_spans = text_.encode(), [], 0, 0, 0
                end = -1
                for a, b in sorted((s["begin"], s["end"]) for s in spans_):
                    if a > end:
                        n_spans += 1
                        kept.append(data[at:a])
                        end = at = b
                        n_removed += b - a
                    elif b > end:
                        n_removed += b - end
                        end = at = b
                rest = b"".join([*kept, data[at:]])
                out.append((key_, n_removed, n_spans, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ("binary", "int64", "int64", "string", "binary"), strict=True)], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    once = texts.filter("copies = 1").join(by_text, "key").select("key", "text", "spans").mapInArrow(strip, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    gone = texts.filter("copies > 1").select("key", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"), F.lit(b"").alias("kept"))
    found = once.unionByName(gone)
    base = rows.select("doc_id", key.alias("key"), n_bytes.cast("long").alias("n_bytes"), sha.alias("_sha"), *[F.encode("text", "utf-8").alias("_bytes")] * with_text)
    out = base.join(found, "key", "left")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "_sha").alias("kept_sha256"), *[F.coalesce("kept", "_bytes").alias("kept")] * with_text,
    )
