import math
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescope.llm import eliasfano, ngramlm as lm

from tests.conftest import SF001

from .conftest import SCHEMA, run


def toks(t):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", t) if w] + [None]


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts, order=lm.ORDER):
        seqs = [toks(t) for t in texts]
        self.order = order
        self.c = Counter(w for s in seqs for w in s)
        self.n, self.v = sum(self.c.values()), len(self.c)
        least = lm.KEPT
        frequent = {(w,): n for w, n in self.c.items() if n >= least}
        low = {(w,): self.base(w) for (w,) in frequent}
        self.prob, self.back = {}, {}
        for k in range(2, order + 1):
            grams = Counter(tuple(s[i : i + k]) for s in seqs for i in range(len(s) - k + 1))
            grams = {g: n for g, n in grams.items() if n >= lm.KEPT and g[:-1] in frequent and g[1:] in frequent}
            taken = Counter()
            for g, n in grams.items():
                taken[g[:-1]] += n - lm.DISCOUNT
            new_low = {}
            for g, n in grams.items():
                total = frequent[g[:-1]]
                b = max((total - taken[g[:-1]]) / total, 1e-12)
                lp = math.log10((n - lm.DISCOUNT) / total + b * 10 ** low[g[1:]])
                self.prob[g], self.back[g[:-1]] = self.q(lp), self.q(math.log10(b))
                new_low[g] = lp
            frequent = {g: n for g, n in grams.items() if n >= least}
            low = new_low
            self.frequent = getattr(self, "frequent", []) + [frequent]

    @staticmethod
    def q(x):
        return -min(math.ceil(-x * lm.UNIT - 1e-9), 65535) / lm.UNIT

    def base(self, w):
        return math.log10((self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def score(self, t):
        s, total = toks(t), 0.0
        for i, w in enumerate(s):
            lp = self.base(w)
            for k in range(2, self.order + 1):
                if i - k + 1 < 0:
                    break
                g = tuple(s[i - k + 1 : i + 1])
                if g[:-1] in self.back:
                    lp = self.prob[g] if g in self.prob else lp + self.back[g[:-1]]
            total += lp
        return len(s), sum(self.c[w] > 0 for w in s), self.n, sum(self.base(w) for w in s), total


def agree(got, plain, texts):
    for r in got:
        n, known, tokens, base, total = plain.score(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(total, rel=1e-6, abs=2e-3)


def test_query_against_plain_model(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = run(spark, "op8_lm_scoring", SF001).collect()
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    plain = Plain([t for i, t in texts.items() if i not in held])
    agree(out, plain, texts)
    assert len(plain.prob) > 1000 and {r.doc_id for r in out if r.held_out} == held
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)


def test_many_files_and_no_mass_above_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    texts = {i: " ".join(rng.choice(words, 40, p=np.arange(60, 0, -1) / 1830)) for i in range(120)}
    monkeypatch.setattr(lm, "SHARD_WORDS", 50)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    model = lm.train(docs, F.lit(True))
    assert all(len(b) > 1 for b in model.bounds)
    plain = Plain(list(texts.values()))
    agree(lm.score(docs, model).collect(), plain, texts)
    trie = lm.Trie(model)
    asked = [f"{c} {w}" for c in ("w0", "w3") for w in [*words, "unseen"]]
    raw = "".join(asked).encode()
    _, _, _, total = trie.score(*lm.tokens(__import__("pyarrow").array(asked)))
    assert len(raw) and np.isfinite(total).all()
    for c in ("w0", "w3"):
        prob = [plain.prob[(c, w)] if (c, w) in plain.prob else plain.back[(c,)] + plain.base(w) for w in [*words, None, "unseen"]]
        assert 0.98 < sum(10**x for x in prob) <= 1 + 1e-9


def test_nulls_empty_long_clashes_and_no_training(spark):
    texts = {1: None, 2: "", 3: "A b a B", 4: "a b " * 60_000, 5: "new\x0bword"}
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()] + [(3, "A b a B", None, None, None)], SCHEMA)
    docs = docs.selectExpr("*", "1 AS h", "2 AS c", "3 AS score", "4 AS p")
    agree(lm.score(docs, lm.train(docs, F.col("doc_id") < 5)).collect(), Plain([*(texts[i] for i in (1, 2, 3, 4)), texts[3]]), texts)
    agree(lm.score(docs, lm.train(docs, F.lit(False))).collect(), Plain([]), texts)
    model = lm.train(docs.limit(0), F.lit(True))
    assert lm.score(docs.limit(0), model).collect() == []


def test_folder_must_be_mounted(spark, monkeypatch):
    monkeypatch.setattr(lm, "scratch_path", lambda s, x: "hdfs://host/x")
    with pytest.raises(ValueError, match="memory-mapped"):
        lm.posix_folder(spark, "x")


@pytest.mark.parametrize("others", [0, 200])
def test_a_rare_gram_is_kept_whatever_the_corpus(spark, others):
    """With 200 other texts the corpus has some 200,000 tokens, of which two are far below any share."""
    rng = np.random.default_rng(5)
    texts = {1: "seldom seen words here", 2: "but seldom seen words there", 3: "seldom seen words"}
    texts |= {10 + i: " ".join(f"w{k}" for k in rng.integers(0, 400, 1000)) for i in range(others)}
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    model = lm.train(docs, F.col("doc_id") != 3)
    plain = Plain([t for i, t in texts.items() if i != 3])
    assert ("seldom", "seen", "words") in plain.prob
    agree(lm.score(docs, model).collect(), plain, texts)
    kept = [sum(len(g) == k for g in plain.prob) for k in (2, 3)]
    assert [int(b[-1]) for b in model.bases[1:]] == kept and (kept == [2, 1] or kept[0] > 50_000)


def test_order_four_and_contexts_in_many_files(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = {i: " ".join(rng.choice(list("abcdef"), 60)) for i in range(60)}
    monkeypatch.setattr(lm, "SHARD_WORDS", 4)  # the children of one context lie in several files
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    agree(lm.score(docs, lm.train(docs, F.lit(True), order=4)).collect(), Plain(list(texts.values()), 4), texts)


def test_counts_are_added_up_once_before_and_once_after_the_shuffle(spark):
    """What tasks have added up goes straight to the shuffle; no second table of it is made there."""
    partial = spark.range(40).selectExpr("id % 7 AS k", "id AS c")
    counts = lm._dealt(partial, "k").groupBy("k").agg(F.sum("c").alias("c"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "HashAggregate" not in plan[plan.index("Exchange hashpartitioning") :]
    assert {r.k: r.c for r in counts.collect()} == {k: sum(range(k, 40, 7)) for k in range(7)}


def test_partial_counts_over_small_and_large_limits():
    import pyarrow as pa

    texts = ["a b a", "", "b c", "a a a a"] * 5
    for limit in (1, 7, 1 << 21):
        batches = iter([pa.RecordBatch.from_pydict({"text": [t]}) for t in texts])
        total = Counter()
        for out in lm._partial_counts(["k", "c"], lm._words, limit)(batches):
            keys, counts = out.column("k").to_pylist(), out.column("c").to_pylist()
            assert keys == sorted(set(keys))
            total.update(dict(zip(keys, counts)))
        assert sorted(total.values()) == [5, 10, 20, 30]


def _two_levels(folder, words, keys, counts):
    """A model's first two levels, written in this process; the second from batches of 100 n-grams."""
    rng = np.random.default_rng(2)
    hashes = np.sort(rng.integers(-(2**63), 2**63 - 1, words))
    often = rng.integers(10**6, 10**7, words)
    model = lm.Model(str(folder), int(often.sum()), words)

    def batches(values, n, name):
        for a in range(0, len(values), n):
            part = values[a : a + n]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), np.int32)), pa.array(part), pa.array((often if name == "h" else counts)[a : a + n])], names=["part", name, "c"])

    for level, write, rows in ((1, lm._write_words(model.folder), batches(hashes, words, "h")), (2, lm._write_counts(model.folder, 2, words), batches(keys, 100, "k"))):
        (made,) = [SimpleNamespace(**{n: made.column(n)[0].as_py() for n in made.schema.names}) for made in write(rows)]
        if level == 2:
            edges = dict(zip(made.edges, made.taken))
            list(lm._write_children(SimpleNamespace(value=model), 2, edges, False)(iter([pa.RecordBatch.from_pydict({"id": [0]})])))
        lm._add_level(model, [made])
    return model, edges


def test_files_written_in_steps_are_the_same(tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    words = 90
    keys = np.unique(np.concatenate([rng.integers(0, words * words, 1500), np.arange(40 * words, 44 * words)]))  # some contexts go on over steps
    counts = rng.integers(2, 50, len(keys))
    files = {}
    for step in (64, 1 << 17):
        monkeypatch.setattr(lm, "STEP", step)
        monkeypatch.setattr(eliasfano, "STEP", step)
        folder = tmp_path / str(step)
        folder.mkdir()
        model, edges = _two_levels(folder, words, keys, counts)
        files[step] = {f.name: f.read_bytes() for f in (folder / "level2-0").iterdir()}
        context = keys // words
        assert edges == {int(e): float((counts[context == e] - lm.DISCOUNT).sum()) for e in (context[0], context[-1])}
        assert lm.Trie(model).numbers(2, context, keys % words).tolist() == list(range(len(keys)))
    assert files[64] == files[1 << 17] and len(files[64]) == 16


def test_writing_a_file_holds_no_second_copy_of_its_ngrams(tmp_path):
    """A range of counts is not gathered, and its file is made in steps: few bytes an n-gram beside the file's own arrays."""
    n, words = 1 << 20, 4000
    keys = np.sort(np.random.default_rng(1).choice(words * words, n, replace=False))
    counts = np.full(n, 3)
    tracemalloc.start()
    lm._trie(_two_levels(tmp_path, words, keys, counts)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n


def test_counts_leave_a_task_in_small_batches():
    texts = [" ".join(f"w{k}" for k in range(i, i + 50_000)) for i in range(0, 400_000, 50_000)]
    out = list(lm._partial_counts(["h", "c"], lm._words)(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    assert max(b.num_rows for b in out) <= lm.STEP
    assert sum(b.num_rows for b in out) == 400_001 and sum(sum(b.column("c").to_pylist()) for b in out) == 400_008
