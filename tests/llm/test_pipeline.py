import hashlib

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from tablescope.llm import queries, stringkernel

from tests.conftest import SF001

from .test_chosenpath import brute as linked
from .test_windowhash import brute as leaked


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "encode"]


def test_whole_pipeline_against_brute_force(spark):
    import re

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    machine = queries.toxicity_machine(spark, SF001)
    margin = {}
    for i, t in docs.items():
        raw = (t or "").encode()
        margin[i] = machine.text_margins(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    left = {i: t for i, t in docs.items() if machine.probability(np.array([margin[i]]))[0] < 0.5}
    seen = {}
    for i in sorted(left):
        seen.setdefault(re.sub(r"[ \t-\r]+", " ", left[i] or ""), i)
    left = {i: left[i] for i in seen.values()}
    near = linked(list(left.items()))
    left = {i: t for i, t in left.items() if near[i][0] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaked(list(left.items()), items)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t in left.items():
        if i not in bad:
            ids = library.encode(t or "", add_bos=True, add_eos=True)
            want[i] = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF001).collect()} == want
    assert 0 < len(want) < len(docs)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c d e f", None, None, 11), (5, "z " * 100_000, "xx", "s", None)]
    for n, own in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs.write.parquet(f"{tmp_path}/{n}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{name}")
            out = stage(spark, docs, SF001)
            assert out.columns == docs.columns
            docs = out
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
        assert last.count() == (3 if own else 0)
    assert isinstance(queries.toxicity_machine(spark, SF001), stringkernel.Machine)
