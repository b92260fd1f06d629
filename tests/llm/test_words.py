import pyarrow as pa
import pyarrow.compute as pc
import pytest

pytest.importorskip("quadweave.llm")
from quadweave.llm._words import slices, texts_of, words_of


def test_slices_give_every_row_its_own_words():
    texts = [None, "", " A b\tÉ ", "x " * 50, "Öl\x0bö", "z"] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = []
    for part in slices([batch], "text", size=40):
        lower = pc.ascii_lower(texts_of(part.column("text")))
        lower.validate(full=True)
        w = words_of(lower)
        distinct = w.distinct.to_pylist()
        got += [[distinct[k] for k in w.codes[a:b]] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
    assert got == [["".join(c.lower() if c.isascii() else c for c in x.decode()) for x in (t or "").encode().split()] for t in texts]
    assert list(slices([batch.slice(0, 0)], "text")) == []
