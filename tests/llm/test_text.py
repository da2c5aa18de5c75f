from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidelog.llm import text as tx


def test_words_equal_split():
    texts = ["a bb  ccc\n", None, "", " x", "y", "été 한글\tz", "tail "]
    words = tx.Words(pa.array(texts))
    got = [words.data[s:e].tobytes().decode() for s, e in zip(words.start, words.end)]
    assert got == [w for t in texts if t for w in t.split()]
    assert words.counts().tolist() == [len(t.split()) if t else 0 for t in texts]


def test_hashes_depend_on_the_word_only():
    words = tx.Words(pa.array(["foo bar", "xx foo", "bar"]))
    h = words.hashes()
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_gram_hashes_match_equal_windows():
    w = np.array([5, 6, 7, 5, 6, 7, 8], dtype=np.uint64)
    g = tx.gram_hashes(w, 3)
    assert len(g) == 5 and g[0] == g[3] and len(set(g.tolist())) == 4
    assert len(tx.gram_hashes(w, 9)) == 0


def test_slices_cover_all_rows_and_long_texts():
    column = pa.array(["a" * 10, "b" * 100, None, "c", "d" * 5])
    got = list(tx.slices(column, 12))
    assert [r for low, high in got for r in range(low, high)] == list(range(5))
    sliced = column.slice(1, 3)
    data, offsets = tx.text_buffer(sliced)
    assert data.tobytes().decode() == "b" * 100 + "c" and offsets.tolist() == [0, 100, 100, 101]
