import re

import numpy as np
import pyarrow as pa
import pytest

from tablescope.llm import common


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_word_hashes_tell_words_apart(block, monkeypatch):
    monkeypatch.setattr(common, "HASH_BLOCK", block)
    rng = np.random.default_rng(block)
    texts = ["", " ", "a", "a\tb  c", "word" * 30, "é\n\x0bü "] + ["".join(rng.choice(list("ab \n"), 40)) for _ in range(60)] + [""]
    data, offsets = flat(texts)
    hashes, at, start, end = common.word_hashes(data, offsets, spans=True)
    words = [w for t in texts for w in re.split("[\x20\x09-\x0d]+", t) if w]
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == words
    assert np.diff(at).tolist() == [len([w for w in re.split("[\x20\x09-\x0d]+", t) if w]) for t in texts]
    by = {}
    for w, h in zip(words, hashes.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_lower_case_and_no_text():
    a, _ = common.word_hashes(*flat(["Ab É"]), lower=True)
    b, _ = common.word_hashes(*flat(["aB É"]), lower=True)
    assert a.tolist() == b.tolist()
    hashes, at = common.word_hashes(np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert len(hashes) == 0 and at.tolist() == [0, 0, 0]


def test_byte_slices_keep_rows_in_order():
    texts = ["x" * n for n in (0, 5, 100, 1, 0, 300, 2, 2)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(common.byte_slices(iter([batch.slice(0, 4), batch.slice(4)]), "text", 100))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert all(sum(len(t or "") for t in p.column("text").to_pylist()) <= 100 or p.num_rows == 1 for p in parts)


def test_shingles():
    h = np.arange(1, 9, dtype=np.uint64)
    assert len(common.shingles(h)) == 4 and len(common.shingles(h[:5])) == 1 and len(common.shingles(h[:2])) == 1
    assert len(common.shingles(h[:0])) == 0 and len(common.shingles(np.full(50, 3, np.uint64))) == 1
    assert common.shingles(h[:2])[0] != common.shingles(h[:3])[0]
