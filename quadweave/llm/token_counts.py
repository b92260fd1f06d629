"""Greedy word-piece lengths by a linear longest-match automaton.

A trie of the vocabulary carries, for each node, the node that is left when
the longest pieces of the string read so far are split off, and how many
pieces those are.  Matching a word then takes one step per byte and never
builds or re-reads a piece.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import slices, sums, texts_of, words_of
from .packing import _byte_letters

_automata: dict[str, "PieceAutomaton"] = {}


class PieceAutomaton:
    """Number of pieces that greedy longest matching from the left gives.

    ``vocabulary`` must contain every single symbol of the alphabet that is
    asked about; a word with any other symbol counts as one unknown piece.
    """

    def __init__(self, vocabulary: list[str]) -> None:
        children: list[dict[str, int]] = [{}]
        is_piece = [False]
        for piece in vocabulary:
            node = 0
            for c in piece:
                at = children[node].get(c)
                if at is None:
                    at = children[node][c] = len(children)
                    children.append({})
                    is_piece.append(False)
                node = at
            is_piece[node] = True
        is_piece[0] = False
        fail, popped = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in children[parent].items():
                queue.append(node)
                if is_piece[node]:
                    fail[node], popped[node] = 0, 1
                    continue
                z, n = fail[parent], popped[parent]
                while z >= 0 and c not in children[z]:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[node], popped[node] = children[z][c], n
        self.children, self.fail, self.popped = children, fail, popped

    def count(self, word: str) -> int:
        children, fail, popped = self.children, self.fail, self.popped
        node = n = 0
        for c in word:
            at = children[node].get(c)
            while at is None:
                if fail[node] < 0:
                    return 1
                n += popped[node]
                node = fail[node]
                at = children[node].get(c)
            node = at
        while node:
            if fail[node] < 0:
                return 1
            n += popped[node]
            node = fail[node]
        return n


def automaton(path: str) -> PieceAutomaton:
    """Of a byte-level vocabulary file in the tokenizers library's form."""
    if path not in _automata:
        _automata[path] = PieceAutomaton(list(json.loads(Path(path).read_text())["model"]["vocab"]))
    return _automata[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_bytes, n_tokens)`` of every row's whole text.

    A word is spelt as the vocabulary's space mark and its UTF-8 bytes, and
    each distinct word of a batch is matched once.  A null or empty text has
    none of either.  Repeated rows stay repeated.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = automaton(vocabulary)
        letters = dict(enumerate(_byte_letters()))
        space = letters[32]
        for batch in slices(batches, "text"):
            texts = texts_of(batch.column("text"))
            words = words_of(texts)
            per_word = np.array([pieces.count(space + w.encode().decode("latin-1").translate(letters)) for w in words.distinct.to_pylist()], "int64")
            tokens = sums(per_word[words.codes], words.offsets) if words.codes.size else np.zeros(len(texts), "int64")
            n_bytes = pc.binary_length(texts).cast("int64")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(words.offsets)), n_bytes, pa.array(tokens)], ["doc_id", "n_words", "n_bytes", "n_tokens"])

    schema = f"doc_id {kind}, n_words long, n_bytes long, n_tokens long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, schema)
