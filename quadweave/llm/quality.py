"""Quality rules: base rules and the divergence of a text from language references.

Two histograms describe a text: of its characters by class, and of the common
words of a few languages.  The references are the same histograms summed over
all documents that read as one of the languages.  A text is rejected if its
Jensen-Shannon distance from every language is large in either; texts too
short for a histogram to mean anything are left to the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import Words, slices, sums, texts_of, words_of

COMMON = {
    "en": "the of and to in that is was for it with as his on be at by had not but from are this have which you or were her an they one all would there".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus ne se ce il sont la avec son aux elle ou mais nous cette".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat sie nach wird bei einer um am".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero sus le ha me si sin sobre este entre cuando".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
#: Character classes: white space, lower and upper case, digits, sentence marks, symbols, other ASCII, any other character, continuation bytes.
N_CLASSES = 9
SYMBOLS = b"#*$%&|<>"
#: A reference needs so many common words; a histogram that is judged, so many words.
MIN_REFERENCE_HITS, MIN_WORDS_CHARS, MIN_WORDS_COMMON = 200, 40, 100
#: The largest distances (square roots of the divergence in bits) that pass.
MAX_CHARS, MAX_COMMON = 0.3, 0.5


def _classes() -> np.ndarray:
    of = np.full(256, 6, "int64")
    of[list(b"\t\n\v\f\r ")] = 0
    of[97:123], of[65:91], of[48:58] = 1, 2, 3
    of[list(b".,;:!?'\"()-")] = 4
    of[list(SYMBOLS)] = 5
    of[192:256], of[128:192] = 7, 8
    return of


def class_counts(texts: pa.Array) -> np.ndarray:
    """Bytes of each row by class."""
    of = _classes()
    offsets = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", "uint8")
    return np.array([np.bincount(of[data[a:b]], minlength=N_CLASSES) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], "int64").reshape(len(texts), N_CLASSES)


def common_counts(words: Words) -> np.ndarray:
    """Words of each row that are common ones, by word, and last all other words."""
    place = {w: i for i, w in enumerate(WORDS)}
    distinct = np.array([place.get(w.lower().strip(".,;:!?"), -1) for w in words.distinct.to_pylist()], "int64")
    n, k = words.offsets.size - 1, len(WORDS)
    of = distinct[words.codes] if words.codes.size else words.codes
    rows = np.repeat(np.arange(n), np.diff(words.offsets))
    hit = of >= 0
    out = np.bincount(rows[hit] * (k + 1) + of[hit], minlength=n * (k + 1)).reshape(n, k + 1)
    out[:, k] = np.diff(words.offsets) - out.sum(axis=1)
    return out


def language(common: np.ndarray) -> np.ndarray:
    """The language whose list has most of a row's words; -1 without any; ties to the first."""
    member = np.array([[w in words for w in WORDS] for words in COMMON.values()], "int64")
    hits = common[:, :-1] @ member.T
    return np.where(hits.max(axis=1, initial=0) > 0, hits.argmax(axis=1), -1)


def repeat_words(words: Words) -> np.ndarray:
    """Words of each row that lie in a five-word window which the row holds twice or more."""
    n_rows, codes, offsets = words.offsets.size - 1, words.codes.astype("int64"), words.offsets
    if codes.size < 5:
        return np.zeros(n_rows, "int64")
    rows = np.repeat(np.arange(n_rows), np.diff(offsets))

    def again(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the combined keys, and whether each key is found twice."""
        order = np.lexsort(parts[::-1])
        new = np.ones(order.size, bool)
        new[1:] = np.logical_or.reduce([p[order[1:]] != p[order[:-1]] for p in parts])
        rank_in_order = np.cumsum(new) - 1
        counts = np.bincount(rank_in_order)
        rank = np.empty(order.size, "int64")
        rank[order] = rank_in_order
        return rank, (counts > 1)[rank]

    # windows of three first, as one exact 64-bit key where codes are small enough
    size = int(codes.max()) + 1
    at = np.flatnonzero(rows[4:] == rows[:-4])
    if size < 1 << 21:
        threes = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
        sorted_ = np.sort(threes[at])
        twice = sorted_[1:][sorted_[1:] == sorted_[:-1]]
        at = at[np.isin(threes[at], np.unique(twice))]
    if not at.size:
        return np.zeros(n_rows, "int64")
    _, twice = again(rows[at], *(codes[at + k] for k in range(5)))
    starts = at[twice]
    covered = np.zeros(codes.size + 1, "int64")
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + 5, -1)
    return sums(np.cumsum(covered)[:-1] > 0, offsets)


def dup_lines(text: str) -> int:
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def distance(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row to its nearest reference; 0 where either side is empty."""
    total = counts.sum(axis=1, keepdims=True)
    if not references.size:
        return np.zeros(len(counts))
    p = counts / np.maximum(total, 1)
    best = np.full(len(counts), np.inf)
    for q in references / references.sum(axis=1, keepdims=True):
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
        best = np.minimum(best, np.sqrt(np.maximum(d / 2, 0)))
    return np.where(total[:, 0] > 0, best, 0)


def references(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Character-class and common-word histograms by language, summed over all documents.

    Each task adds its rows up; the driver receives languages times bins sums.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(COMMON), N_CLASSES + len(WORDS) + 1), "int64")
        for batch in slices(batches, "text"):
            texts = texts_of(batch.column("text"))
            common = common_counts(words_of(texts))
            of, counts = language(common), np.hstack([class_counts(texts), common])
            for i in range(len(COMMON)):
                total[i] += counts[of == i].sum(axis=0)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "n"])

    sums_ = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(add_up, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    total = np.zeros((len(COMMON), N_CLASSES + len(WORDS) + 1), "int64")
    for row in sums_.collect():  # languages times bins
        total[row["i"], row["j"]] = row["n"]
    total = total[total[:, N_CLASSES:-1].sum(axis=1) >= MIN_REFERENCE_HITS]
    return total[:, 1 : N_CLASSES - 1], total[:, N_CLASSES:]


METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_distance double, common_distance double, base_failed boolean, kept boolean"


def judge(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default) and the columns of ``METRICS``, one row per document.

    A carried column with the name of a metric is left out.  A null or empty
    text has no words and fails the base rules.  Repeated rows are judged
    alike.  An empty corpus has no references and gives no rows.
    """
    names = [m.split()[0] for m in METRICS.split(", ")]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in names]
    chars_ref, common_ref = references(docs, text_col)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = texts_of(batch.column("_text"))
            words = words_of(texts)
            n_words, classes = np.diff(words.offsets), class_counts(texts)
            repeats = repeat_words(words)
            base_failed = (n_words < 10) | (100 * repeats > 20 * n_words)
            chars = np.where(n_words >= MIN_WORDS_CHARS, distance(classes[:, 1 : N_CLASSES - 1], chars_ref), 0)
            common = np.where(n_words >= MIN_WORDS_COMMON, distance(common_counts(words), common_ref), 0)
            kept = ~base_failed & (chars <= MAX_CHARS) & (common <= MAX_COMMON)
            dups = np.array([dup_lines(t) for t in texts.to_pylist()], "int64")
            found = [n_words, classes[:, 1:8].sum(axis=1), classes[:, 5], dups, repeats, chars.astype("float64"), common.astype("float64"), base_failed, kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *map(pa.array, found)], [*carry, *names])

    schema = type(docs.schema)([docs.schema[c] for c in carry])
    for field in METRICS.split(", "):
        schema = schema.add(*field.split())
    return docs.select(*(F.col(f"`{c}`") for c in carry), F.col(text_col).cast("string").alias("_text")).mapInArrow(rate, schema)


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns, whatever their names."""
    numbered = [f"_{i}" for i in range(len(docs.columns))]
    judged = judge(docs.toDF(*numbered), numbered[docs.columns.index(text_col)])
    return judged.filter("kept").select(*numbered).toDF(*docs.columns)
