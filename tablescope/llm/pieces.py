"""Subword encoding and decoding with a distinct-chunk table.

No piece of the vocabulary joins a character to a white-space marker that
follows it, nor a letter to another character, so a marked text is cut before
each run of markers and between letters and others, and every chunk is
segmented on its own.  A worker segments each distinct chunk once, keeps the
ids and the surface in a table, and joins the ids back by position (the order
of the chunks in the text).  The table is bounded by bytes and starts anew
when full, which costs time, never results.

``check_boundaries`` proves these properties from the vocabulary when the
model is opened; a model without them is refused.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices

MARK = "▁"
ANCHOR = "\n"  #: in no piece, so nothing merges with it
# Any two classes do, as long as no piece has both; a superscript two is not with the letters.
_PLAIN = re.compile(r"[^\W\d_²]*|(?:[^\w]|[\d_²])*")
_CHUNK = re.compile(r" *(?:[^\W\d_²]+|(?:[^\w ]|[\d_²])+)| +")
TABLE_BYTES = 160 << 20  #: that the table of a worker may take
ENTRY_BYTES = 220  #: what an entry costs besides its contents
ID_TYPE = "<u4"  #: ids are stored as little-endian unsigned 32-bit integers


def check_boundaries(model: sentencepiece.SentencePieceProcessor) -> None:
    """Raise unless pieces hold markers only at their start, and letters only with letters."""
    for i in range(model.get_piece_size()):
        body = model.id_to_piece(i).lstrip(MARK)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (MARK in body or ANCHOR in body or not _PLAIN.fullmatch(body)):
            raise ValueError(f"piece {i} crosses a border of chunks; they cannot be segmented apart")


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


class ChunkTable:
    """Ids and surfaces of distinct chunks for one model."""

    def __init__(self, model: bytes, limit: int = TABLE_BYTES):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        check_boundaries(self.model)
        self.limit, self.held = limit, 0
        # Bytes and texts only: the garbage collector does not walk over such dictionaries.
        self.entries: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # surfaces that differ from their chunk
        self.begin, self.end = (pack([i]) for i in (self.model.bos_id(), self.model.eos_id()))
        # A chunk is encoded behind an anchor, so that the marker which the library puts before a text never touches it.
        self.anchor = self.model.encode(ANCHOR)
        plain = lambda i: not (self.model.is_byte(i) or self.model.is_unknown(i) or self.model.is_control(i))
        self.surface = [self.model.id_to_piece(i).replace(MARK, " ") if plain(i) else None for i in range(self.model.get_piece_size())]

    def _fill(self, chunks: list[str]) -> None:
        n = len(self.anchor)
        for chunk, ids in zip(chunks, self.model.encode([ANCHOR + c for c in chunks], num_threads=1)):
            own = ids[n:]
            parts = [self.surface[i] for i in own]
            surface = self.model.decode(ids)[len(ANCHOR) :] if None in parts else "".join(parts)
            self.entries[chunk] = packed = pack(own)
            if surface != chunk:
                self.odd[chunk] = surface
            self.held += len(chunk) + len(packed) + ENTRY_BYTES

    def encode(self, text: str) -> tuple[bytes, str]:
        """(packed ids with begin and end, decoded text) of a whole text."""
        chunks = cut(text)
        missing = list({c for c in chunks if c not in self.entries})
        if missing:
            if self.held > self.limit:
                self.entries, self.odd, self.held = {}, {}, 0
                missing = list(set(chunks))
            self._fill(missing)
        ids = b"".join([self.begin, *map(self.entries.__getitem__, chunks), self.end])
        surfaces = [self.odd.get(c, c) for c in chunks] if self.odd else chunks
        return ids, "".join(surfaces)[1:]  # without the blank that the library puts first


def cut(text: str) -> list[str]:
    """The chunks of a text with the blank that the library puts first: blanks, then letters or others."""
    return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


_tables: dict[tuple[int, int], ChunkTable] = {}  #: of this worker; the table lives on from task to task


def _table(model: bytes, limit: int) -> ChunkTable:
    key = hash(model), limit
    if key not in _tables:
        _tables.clear()
        _tables[key] = ChunkTable(model, limit)
    return _tables[key]


def encode(docs: DataFrame, model_file: str, text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with ``ids`` (binary: packed little-endian ids, begin and end included) and ``decoded``.

    Exactly what the library gives for every whole text with begin and end
    ids and no sampling, and what its ``decode`` makes of those ids.  A NULL
    or empty text has the two ids and decodes to the empty string.  Existing
    columns named ``ids`` or ``decoded`` are replaced.  Rows are not
    shuffled, so skew of a key or a text costs nothing here.
    """
    spark = docs.sparkSession
    with open(model_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model.value, table_bytes)
        for part in byte_slices(batches, text):
            pairs = [table.encode(t or "") for t in part.column(text).to_pylist()]
            new = [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "ids", "decoded"])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(rows: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the library's text of the packed ``ids``; NULL ids give NULL."""
    spark = rows.sparkSession
    with open(model_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    kept = [c for c in rows.columns if c != "decoded"]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _table(model.value, TABLE_BYTES).model
        for part in byte_slices(batches, ids):
            texts = [None if b is None else library.decode(np.frombuffer(b, ID_TYPE).tolist()) for b in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return rows.select(*kept).mapInArrow(run, schema)


def digest(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded rows."""
    return encoded.select(
        F.col(key).alias("doc_id"),
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
