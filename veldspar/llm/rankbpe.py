"""Byte-level BPE by a rank file, with the tiktoken library.

Tasks encode whole texts; ids travel as packed little-endian unsigned 32-bit integers, four bytes each.  A long text is cut
first, at places where the pattern always ends one match and begins the next whatever stands around them, so that neither the pattern
nor the library ever sees more than a part; the ids of the parts, one after the other, are those of the whole text.  Ids are
decoded to the tokens' raw bytes, which need not be UTF-8 where ids were cut.
"""

from __future__ import annotations

import base64
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ._words import blocks, give_back, take

#: Texts of more code points are cut into parts of about so many.
PART = 1 << 16

#: A place before which no match can go on and from which matching doesn't look back.  First: white space after a character that
#: isn't (only a run of white space crosses into white space).  Second: a mark after a letter or digit (runs of letters or digits end
#: there).  Letters, digits and marks of these ranges are so in every version of Unicode; the apostrophe, which opens a match of its own, isn't among the marks.
_SAFE = re.compile(
    r"(?<=[^\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff])[\t\n\r ]"
    r"|(?<=[A-Za-z0-9\xc0-\xd6\u0430-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])[.,;:!?()\u3001\u3002\uff01\uff0c\uff1f]"
)


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts of ``size`` code points or more, each up to the next safe place; a text without one is one part."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Ranks:
    """The encoding of a rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in lines}, special_tokens={})

    def encode(self, text: str, size: int = PART) -> np.ndarray:
        if len(text) <= size:
            return np.array(self.encoding.encode_ordinary(text), "<u4")
        return np.concatenate([np.array(self.encoding.encode_ordinary(x), "<u4") for x in parts(text, size)])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


@lru_cache(2)
def _ranks(name: str, pattern: str) -> Ranks:
    return Ranks(SparkFiles.get(name), pattern)


def _publish(spark: SparkSession, path: str) -> str:
    """Send the rank file to the executors; its name there."""
    ship(spark)
    at = Path(tempfile.mkdtemp(prefix="veldspar-")) / f"ranks-{uuid.uuid4().hex}.tiktoken"
    at.write_bytes(Path(path).read_bytes())
    spark.sparkContext.addFile(str(at))
    return at.name


def _encode(name: str, pattern: str, decode: bool, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(name, pattern)
        for block in blocks(batches, "_text", 4 << 20):
            ids = [ranks.encode(block.bytes_of(i).decode("utf-8", "replace"), size) for i in range(len(block))]
            cols = [*take(block, ["_own"]), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            if decode:
                cols.append(pa.array([ranks.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["_own", "n_tokens", "ids", "decoded"][: 3 + decode])
        give_back()

    return run


def encode_ranks(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, part: int = PART) -> DataFrame:
    """(id_col, n_tokens long, ids binary[, decoded binary]), one row per row of ``docs``.

    ``ids`` are those that the library gives for the whole text by the rank file at ``path`` and ``pattern`` (the pattern
    of public_tokenizers, of which ``parts`` knows the safe places), without special tokens: strings that look like one are ordinary text.  Packed as
    little-endian unsigned 32-bit integers.  ``decoded`` are the bytes of these ids.  Null text counts as empty: no ids, no bytes.
    Ids of documents may be null, repeat or be of any type; rows don't affect each other.  Bytes that aren't UTF-8 become U+FFFD.  Other columns are not read.
    """
    name, kind = _publish(docs.sparkSession, path), docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_own"), F.col(text_col).cast("binary").alias("_text"))
    got = rows.mapInArrow(_encode(name, pattern, decode, part), f"_own {kind}, n_tokens long, ids binary" + ", decoded binary" * decode)
    return got.withColumnRenamed("_own", id_col)


def _decode(name: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(name, pattern)
        for block in blocks(batches, "_ids", 4 << 20):
            raw = [ranks.decode(np.frombuffer(block.bytes_of(i), "<u4")) for i in range(len(block))]
            yield pa.RecordBatch.from_arrays([*take(block, ["_own"]), pa.array(raw, pa.binary())], names=["_own", "decoded"])
        give_back()

    return run


def decode_ranks(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded binary): the raw bytes of packed ids, one row per row.

    Null ids count as none.  An id that the rank file lacks, or bytes that aren't a multiple of four, are an error.
    """
    name, kind = _publish(encoded.sparkSession, path), encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("_own"), F.col(ids_col).alias("_ids"))
    return rows.mapInArrow(_decode(name, pattern), f"_own {kind}, decoded binary").withColumnRenamed("_own", id_col)
