import numpy as np
import pytest

from tablescope.llm.eliasfano import STEP, EliasFano


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 2**63), (5, 3), (63, 1000), (64, 2**40), (1000, 500), (5000, 2**64 - 1), (3000, 10**7)])
def test_against_sorted_arrays(n, top, tmp_path):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    if n > 100:
        v[10:60] = v[10]
        v.sort()
    EliasFano.build(v).save(str(tmp_path), "x")
    ef = EliasFano.open(str(tmp_path), "x")
    assert ef.at(np.arange(n)).tolist() == v.tolist()
    asked = np.concatenate([v, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)])
    if n:
        assert ef.successor(asked).tolist() == np.searchsorted(v, asked, "left").tolist()
        lo = rng.integers(0, n + 1, len(asked))
        hi = np.minimum(n, lo + rng.integers(0, 50, len(asked)))
        want = np.clip(np.searchsorted(v, asked, "left"), lo, hi)
        assert ef.successor(asked, lo, hi).tolist() == want.tolist()
        place = ef.find(asked, lo, hi)
        assert place.tolist() == [int(w) if w < h and v[w] == x else -1 for w, h, x in zip(want, hi, asked)]
    found = ef.find(asked)
    assert ((found >= 0) == np.isin(asked, v)).all()


def test_is_compact():
    v = np.sort(np.random.default_rng(0).integers(0, 2**64 - 1, 200_000, dtype=np.uint64))
    assert EliasFano.build(v).nbytes * 8 / len(v) < 64 - np.log2(len(v)) + 5


def test_long_runs_of_equal_upper_bits():
    """Buckets that go over many words of the unary part."""
    v = np.concatenate([np.arange(7, dtype=np.uint64), np.arange(5000, dtype=np.uint64) + np.uint64(2**30), np.array([2**50], np.uint64)])
    ef = EliasFano.build(v)
    asked = np.concatenate([v, v + np.uint64(1), v[7:] - np.uint64(1)])
    assert ef.successor(asked).tolist() == np.searchsorted(v, asked, "left").tolist()
    assert ((ef.find(asked) >= 0) == np.isin(asked, v)).all() and ef.at(ef.find(v)).tolist() == v.tolist()


@pytest.mark.parametrize("n", [STEP - 1, STEP, STEP + 1, 2 * STEP + 77])
def test_sequences_of_several_steps(n):
    v = np.sort(np.random.default_rng(n).integers(0, 2**45, n, dtype=np.uint64))
    ef = EliasFano.build(v)
    assert np.array_equal(ef.at(np.arange(n)), v)
