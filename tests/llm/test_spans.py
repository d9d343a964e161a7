import re

import numpy as np
import pyarrow as pa
import pytest

from tablescope.llm import spans
from tablescope.llm.common import bytes_of


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_words_and_hashes_do_not_depend_on_blocks(monkeypatch, block):
    monkeypatch.setattr(spans, "HASH_BLOCK", block)
    texts = ["ab c", None, "", "d", "e f", " ", "g" * 600 + " h", "ab"]
    data, offsets = bytes_of(pa.array(texts))
    inside = ~spans.byte_class((0x20, 0x20))
    start, end, at = spans.word_spans(data, offsets, inside)
    words = [[data[start[k] : end[k]].tobytes().decode() for k in range(at[i], at[i + 1])] for i in range(len(texts))]
    assert words == [re.findall("[^ ]+", t or "") for t in texts]
    flat = [w for ws in words for w in ws]
    for seed in (0, 5):
        hashes = spans.span_hashes(data, start, end, seed)
        of = dict(zip(flat, hashes.tolist()))
        assert [of[w] for w in flat] == hashes.tolist() and len(set(of.values())) == len(of)
    assert (spans.span_hashes(data, start, end, 0) != spans.span_hashes(data, start, end, 5)).all()


def test_no_bytes():
    start, end, at = spans.word_spans(np.zeros(0, np.uint8), np.zeros(3, np.int64), spans.byte_class((0, 255)))
    assert len(start) == len(end) == 0 and at.tolist() == [0, 0, 0]
    assert len(spans.span_hashes(np.zeros(0, np.uint8), start, end)) == 0
