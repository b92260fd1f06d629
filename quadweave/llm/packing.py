"""Best-fit packing by minimum bin slack.

Documents become token ids, ids become pieces of at most ``capacity`` tokens,
and pieces fill sequences.  Which *lengths* share a sequence is decided on the
histogram of lengths alone: it has at most ``capacity`` entries whatever the
corpus, so the driver can hold it.  Per bin, a bitset subset-sum dynamic
programme over the lengths still available finds the fullest combination with
the largest remaining length; that combination is removed as many times as the
histogram allows.  Pieces are then ranked within their length and looked up in
the plan, so no group of pieces ever meets in one task.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut
from ._words import slices, texts_of, words_of

CAPACITY = 4096
#: Rows of one length that one window partition ranks, about.
RANK_ROWS = 100_000

_encoders: dict[str, "TextEncoder"] = {}


#: Words in which the tokenizer's splitter is simple: printable ASCII and the Latin letters of one code page.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_BREAK = "\x01"
_RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|\x01|'(?:s|t|re|ve|m|ll|d)|[^\x01a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def _merger(spec: dict) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """A byte-pair merger for runs that end in NUL, and the ids of its tokens, the break's last.

    NUL stands for the vocabulary's end-of-word mark: joining it to the last
    byte comes before every merge of the vocabulary.
    """
    import tiktoken

    vocab, letters = spec["model"]["vocab"], _byte_letters()
    byte = {c: i for i, c in enumerate(letters)}

    def spelt(token: str) -> bytes:
        stem = token.removesuffix("</w>")
        return bytes(byte[c] for c in stem) + b"\0" * (stem != token)

    ids = [vocab.get(c, 0) for c in letters]
    ranks = {bytes([b]): b for b in range(256)}
    for b, c in enumerate(letters):
        ranks[bytes([b, 0])] = len(ids)
        ids.append(vocab[c + "</w>"])
    for merge in spec["model"]["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if (key := spelt(left) + spelt(right)) not in ranks:
            ranks[key] = len(ids)
            ids.append(vocab[left + right])
    last = ranks.pop(b"\1\0")
    ranks |= {key: rank - 1 for key, rank in ranks.items() if rank > last}
    ranks[b"\1\0"] = len(ids) - 1
    ids.append(ids.pop(last))
    coder = tiktoken.Encoding("runs", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={})
    return coder.encode_ordinary, np.array(ids)


class TextEncoder:
    """Token ids of batches of whole texts, put together from the ids of their words.

    A tokenizer of the known shape (byte-level merges with word ends, white
    space dropped) treats ASCII white space as a boundary that no token
    crosses, so a text's ids are its words' ids in turn, and each distinct
    word of a batch is worked out once.  Plain words are split into runs for a
    fast merger; any other word, and one that may spell a special token, goes
    to the tokenizer itself, and so does the whole text under any other kind
    of tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        self.by_word = spec["model"].get("end_of_word_suffix") == "</w>" and _SPLIT in json.dumps(spec["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        if self.by_word:
            self.merge, self.id_of = _merger(spec)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All their ids in turn, and where each word's begin (and the end)."""
        plain = [w if _PLAIN.fullmatch(w) and "<|" not in w else "" for w in words]
        runs = _RUNS.findall(_BREAK.join(plain).lower() + _BREAK)
        ranks = np.array(self.merge("\0".join(runs) + "\0"), "int64")
        ends = np.flatnonzero(ranks == self.id_of.size - 1)
        ids = np.delete(self.id_of[ranks], ends)
        starts = np.concatenate([[0], ends - np.arange(ends.size)])
        odd = [i for i, (w, p) in enumerate(zip(words, plain, strict=True)) if w and not p]
        if odd:
            found = [self.whole(words[i]) for i in odd]
            ids = np.insert(ids, np.repeat(starts[odd], [f.size for f in found]), np.concatenate(found))
            grown = np.zeros(starts.size, "int64")
            grown[np.array(odd) + 1] = [f.size for f in found]
            starts = starts + np.cumsum(grown)
        return ids.astype("<u4"), starts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in turn, and where each row's begin (and the end)."""
        if not self.by_word:
            found = [self.whole(t) for t in texts.to_pylist()]
            return np.concatenate([*found, np.array([], "<u4")]).astype("<u4"), np.concatenate([[0], np.cumsum([f.size for f in found], dtype="int64")])
        words = words_of(texts)
        ids, starts = self.of_words(words.distinct.to_pylist())
        sizes = np.diff(starts)[words.codes]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if ends.size else 0) + np.repeat(starts[words.codes] - (ends - sizes), sizes)
        return ids[at], np.concatenate([[0], ends])[words.offsets]


def encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def token_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` per piece.

    A null or empty text is the end token alone.  Repeated rows give repeated
    pieces; a null id stays null.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer)
        for batch in slices(batches, "text", size=8 << 20):
            keys = batch.column("id")
            ids, starts = tok.encode(texts_of(batch.column("text")))
            data = memoryview(ids.tobytes())
            rows: list[tuple] = []
            for row, (a, b) in enumerate(itertools.pairwise(starts.tolist())):
                for piece, at in enumerate(range(a, b + 1, capacity)):
                    part = bytes(data[4 * at : 4 * min(at + capacity, b)]) + end * (at + capacity > b)
                    rows.append((row, piece, at - a, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
            columns = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0], "int64")), *(pa.array(c, t) for c, t in zip(columns[1:], ("int32", "int64", "int64", "int64", "binary")[: 4 + with_ids], strict=True))], names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut_up, schema)


def fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths whose sum is largest within ``room``."""
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for size in order:
        most = min(counts[size], room // size)
        k = 1
        while most > 0:
            take = min(k, most)
            grown = (reach | (reach << (size * take))) & mask
            if grown != reach:
                steps.append((size, take, reach))
                reach = grown
                if reach >> room & 1:
                    most = 0
                    break
            most -= take
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            used[size] = used.get(size, 0) + take
            total -= size * take
    return used


def slack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """``(lengths with their multiplicity, number of such bins)`` until nothing is left."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    order = sorted(counts, reverse=True)
    plan = []
    while order:
        largest = order[0]
        counts[largest] -= 1
        used = fullest(counts, [x for x in order if counts[x] and x <= capacity - largest], capacity - largest)
        counts[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        bins = min(counts[k] // v for k, v in used.items())
        for k, v in used.items():
            counts[k] -= v * bins
        order = [x for x in order if counts[x]]
        plan.append((used, bins))
    return plan


def plan_table(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, multiplicity, first sequence and place within it, per bin pattern."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for used, bins in plan:
        offset = 0
        for size in sorted(used, reverse=True):
            rows.setdefault(size, []).append((taken.get(size, 0), used[size], first, offset))
            taken[size] = taken.get(size, 0) + used[size] * bins
            offset += size * used[size]
        first += bins
    return {k: tuple(np.array(x, "int64") for x in zip(*v, strict=True)) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (which must be cheap to read twice).

    Needs columns ``doc_id, piece, start, length, ids_crc32`` and carries any
    others.  An empty table gives an empty result; rows that are equal in all
    five columns are interchangeable.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = plan_table(slack_plan(histogram, capacity))
    buckets = max(1, -(-max(histogram.values(), default=1) // RANK_ROWS))

    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = (
        bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
        .select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    )
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = bucketed.withColumn("_rank", within.cast("long") - 1).join(before, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_bucket", "_before")

    names = pieces.columns
    schema = type(pieces.schema)(list(pieces.schema.fields)).add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, ranks = batch["length"].to_numpy("int64"), batch["_rank"].to_numpy("int64")
            sequence, offset = np.empty_like(sizes), np.empty_like(sizes)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                starts, copies, first, place_ = table[int(size)]
                i = np.searchsorted(starts, ranks[at], "right") - 1
                k = ranks[at] - starts[i]
                sequence[at] = first[i] + k // copies[i]
                offset[at] = place_[i] + k % copies[i] * size
            yield batch[names].assign(sequence_id=sequence, offset=offset)

    return ranked.select(*names, "_rank").mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **named: object) -> DataFrame:
    """Tokenises, cuts and packs; the ids are computed once and kept in the shared folder."""
    return pack(cut(token_pieces(docs, tokenizer, capacity=capacity, **named)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: the sequences themselves, for pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
