"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bytecnn, chosenpath, collocations, crossparse, decontaminate, grace_dedup, licenses, ngramlm, pieces, resample, reshard, simhash, stringkernel
from .common import id_remainder, read_table

PIECES = "piece_bpe_32k.model"


def _not_held_out() -> Column:
    return id_remainder(F.col("doc_id"), 5) != 0


def toxicity_machine(spark: SparkSession, sf_dir: str) -> stringkernel.Machine:
    """The machine that op1 and the pipeline use, learned from ``documents`` and ``labels``."""
    return stringkernel.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "toxic", _not_held_out())


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stringkernel.score(read_table(spark, sf_dir, "documents"), toxicity_machine(spark, sf_dir))
    return scored.select("doc_id", (~_not_held_out()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SHARDS = 40


def op2_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From shards dealt by source, where one source holds a third, to 40 shards of near-equal bytes."""
    docs = read_table(spark, sf_dir, "documents")
    old = F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % SHARDS
    placed = reshard.reshard(docs, old, SHARDS, scratch_path(spark, "shards"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    found = crossparse.identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digest(pieces.encode(docs, public_tokenizers.path(PIECES)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net = bytecnn.train(docs, read_table(spark, sf_dir, "labels"), "quality", _not_held_out())
    scored = bytecnn.score(docs, net)
    return scored.select("doc_id", (~_not_held_out()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.join(read_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"), licenses.templates(spark))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 1
    scored = ngramlm.score(docs, ngramlm.train(docs, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.deduplicate(read_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP10_SQL = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""



def _shingle_sql(source: str, key: str, width: str = "least(5, len(w))") -> str:
    """Distinct (key, width, shingle) of the rows of ``source``, which have ``key, w``."""
    return f"""
  SELECT DISTINCT {key}, width, array_to_string(w[i:i + width - 1], ' ') AS shingle FROM (
    SELECT {key}, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM (SELECT {key}, w, {width} AS width FROM {source}) WHERE width > 0 AND len(w) >= width)"""


def _word_sql(source: str, key: str) -> str:
    return f"SELECT {key}, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {source}"


def _containment_sql(items: str, key: str, count: str) -> str:
    return f"""
WITH iw AS ({_word_sql(f"(SELECT *, row_number() OVER () AS k FROM {items})", f"k, {key}")}),
i AS ({_shingle_sql("iw", f"k, {key}")}),
n AS (SELECT k, count(*) AS {count} FROM i GROUP BY ALL),
dw AS ({_word_sql("documents", "doc_id")}),
d AS ({_shingle_sql("dw, (SELECT DISTINCT width AS runs FROM i)", "doc_id", "runs")})
SELECT doc_id, {key}, count(*)::INT AS n_shared, any_value({count})::INT AS {count}, count(*) / any_value({count}) AS containment
FROM d JOIN i USING (width, shingle) JOIN n USING (k) GROUP BY doc_id, k, {key}
HAVING count(*) / any_value({count}) >= 0.8
"""


OP7_SQL = _containment_sql(
    "(VALUES " + ", ".join(f"('{k}', '{t}')" for k, t in licenses.TEMPLATES.items()) + ") AS t(license, text)", "license", "n_template"
)
OP9_SQL = _containment_sql("benchmark", "item_id", "n_item")

OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, list(s ORDER BY s) AS l FROM s GROUP BY doc_id),
same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS copy_id FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.8 * (any_value(na.n) + any_value(nb.n) - count(*)) - 1e-9
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), tops AS (SELECT a, min(least(a, b)) AS class_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(copy_id, d.doc_id) AS copy_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN same ON same.doc_id = d.doc_id LEFT JOIN tops ON tops.a = d.doc_id LEFT JOIN counted ON counted.a = d.doc_id
"""

def _collocation_sql() -> str:
    """Phrases of two to four words, their best cuts and the longer ones around them, per language."""
    cuts = " UNION ALL ".join(
        f"SELECT lang, w, a, {k} AS k, {c} AS cut, w[1:{c}] AS p, w[{c + 1}:{k}] AS q FROM cand WHERE len(w) = {k}" for k in (2, 3, 4) for c in range(1, k)
    )
    inner = " UNION ALL ".join(f"SELECT lang, w[{i}:{i + m - 1}] AS w, a FROM cand WHERE len(w) = {k}" for k in (3, 4) for m in range(2, k) for i in range(1, k - m + 2))
    grams = " UNION ALL ".join(f"SELECT lang, w[i:i + {k - 1}] AS w FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in (1, 2, 3, 4))
    return f"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)
), f AS (SELECT lang, w, count(*) AS a FROM ({grams}) GROUP BY lang, w HAVING count(*) >= {collocations.LEAST}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
cand AS (SELECT lang, w, a FROM f WHERE len(w) > 1),
around AS (SELECT lang, w, max(a) AS m FROM ({inner}) GROUP BY lang, w),
cuts AS ({cuts}),
scored AS (
  SELECT c.lang, c.w, c.a, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a))::BIGINT AS score, c.cut
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.w = c.p JOIN f y ON y.lang = c.lang AND y.w = c.q
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
kept AS (
  SELECT best.lang, array_to_string(best.w, ' ') AS phrase, a, l, r, score FROM best LEFT JOIN around ON around.lang = best.lang AND around.w = best.w
  WHERE coalesce(100 * m < {collocations.COVERED} * a, true)
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= {collocations.TOP}
"""


OP11_SQL = _collocation_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_resharding": op2_resharding,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality": op5_quality,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_license_scan": op7_license_scan,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontamination": op9_decontamination,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_collocations": op11_collocations,
    "op12_simhash": op12_simhash,
    "op13_resampling": op13_resampling,
}

ORACLES: dict[str, str] = {
    "op6_jaccard_join": OP6_SQL,
    "op7_license_scan": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_collocations": OP11_SQL,
}
