import random

import numpy as np
import pyarrow as pa

from calibrant.llm.columns import shingles, slices, split_words

rng = random.Random(4)
PARTS = ["a", "Be", "\x1c", " ", " ", "\n", "\t", "\x0b", "é", "word" * 20, "zz" * 60, ""]
TEXTS = [None, "", " ", "one", *("".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(300))]


def test_words_are_those_of_a_bytes_split():
    words = split_words(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        at = range(words.first[i], words.first[i + 1])
        got = [words.data[words.start[k]:words.end[k]].tobytes() for k in at]
        assert got == (text or "").encode().lower().split()


def test_hashes_depend_on_the_word_alone():
    words = split_words(pa.array(TEXTS))
    seen = {}
    for k, h in enumerate(words.hashes()):
        seen.setdefault(words.data[words.start[k]:words.end[k]].tobytes(), set()).add(int(h))
    assert all(len(found) == 1 for found in seen.values())
    assert len(set.union(*seen.values())) == len(seen)
    # A slice of a larger array, and another batch, give the same.
    part = split_words(pa.array(["skip", *TEXTS]).slice(1))
    assert np.array_equal(part.hashes(), words.hashes())


def test_shingles_are_runs_of_words():
    grams, document = shingles(split_words(pa.array(TEXTS)), 3)
    names = {}
    for i, text in enumerate(TEXTS):
        w = (text or "").encode().lower().split()
        runs = [tuple(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] if w else []
        got = grams[document == i]
        assert len(got) == len(runs)
        for run, gram in zip(runs, got):
            assert names.setdefault(run, gram) == gram
    assert len(set(names.values())) == len(names)


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])
    for size in (1, 100, 1 << 20):
        got = [text for part in slices(batch, "text", size) for text in part.column(0).to_pylist()]
        assert got == TEXTS
    assert list(slices(batch.slice(0, 0), "text")) == []
