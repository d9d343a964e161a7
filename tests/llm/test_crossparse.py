import zlib

import numpy as np
from pyspark.sql import functions as F

from tablescope.llm import crossparse as cp

from tests.conftest import SF001

from .conftest import SCHEMA, run


def naive(sample: bytes, text: bytes) -> int:
    phrases = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample and text[at : at + n] in sample:
            n += 1
        phrases += 1
        at += n
    return phrases


def fold(t: str):
    b = t.encode()
    return cp.symbols(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].tobytes()


def test_phrases_against_plain_search():
    rng = np.random.default_rng(5)
    samples = {k: bytes(rng.choice(list(a), 300).astype(np.uint8)) for k, a in (("x", b"abc "), ("y", b"abd "))}
    texts = [bytes(rng.choice(list(b"abcde "), n).astype(np.uint8)) for n in (0, 1, 2, 7, 60, 900, 1024)]
    parser = cp.Parser.build(samples)
    s = np.frombuffer(b"".join(texts), np.uint8)
    got = parser.phrases(s, np.cumsum([0, *map(len, texts)]))
    for k, lang in enumerate(parser.langs):
        assert got[k].tolist() == [naive(samples[lang], t) for t in texts]


def test_long_texts_are_parsed_whole():
    sample = b"the cat sat on the mat "
    parser = cp.Parser.build({"a": sample})
    text = b"the mat zz" * 1000
    parts = [text[i : i + cp.SEGMENT] for i in range(0, len(text), cp.SEGMENT)]
    got = parser.phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert got[0, 0] == sum(naive(sample, p) for p in parts)


def test_symbols():
    assert fold("ÀB  c\n\t1,É_ß") == "àb c é ß".encode()


def test_accuracy_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = run(spark, "op3_language_id", SF001).collect()
    assert sorted(r.doc_id for r in out) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in held]) > 0.95


def test_nulls_empty_texts_and_no_labels(spark):
    rows = [(1, "hello there my friend", "en", None, None), (2, "bonjour mon ami", "fr", None, None), (3, None, "en", None, None), (4, "", None, None, None), (5, "123 !!", "en", None, None), (None, "hello my", None, None, None), (7, "ami " * 50_000, None, None, None), (7, "ami", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'q' AS score", "'r' AS lang_pred", "1 AS h")
    out = cp.identify(docs, F.lit(True)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, None, 7)] == ["en", "fr", "und", "und", "und", "en", "fr"]
    assert all(r.lang_pred == "und" and r.score == 0 for r in cp.identify(docs, F.lit(False)).collect())
    assert cp.identify(docs.limit(0), F.lit(True)).collect() == []


def test_pieces_come_from_the_whole_text_and_a_language_keeps_its_share(spark):
    """Documents of a language share their opening; how many languages there are changes no sample."""
    rng = np.random.default_rng(2)
    opening = "shared opening of all documents " * 40
    rows = [(i, opening + " ".join(f"w{c}" for c in rng.choice(list("abcdefgh"), 2000)), "en", None, None) for i in range(300)]
    alone = cp.sample(spark.createDataFrame(rows, SCHEMA), F.lit(True))["en"]
    assert 0.9 * cp.SAMPLE_SYMBOLS < len(alone) <= cp.SAMPLE_SYMBOLS
    assert alone.count(b"opening") < 0.1 * alone.count(b" wa") + 200
    others = [(1000 + i, f"other words {i} of language {i % 40}", f"l{i % 40}", None, None) for i in range(400)]
    many = cp.sample(spark.createDataFrame(rows + others, SCHEMA), F.lit(True))
    assert many["en"] == alone and len(many) == 41
