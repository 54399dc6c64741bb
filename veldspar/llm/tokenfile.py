"""Token ids in files of compressed planes.

A file holds the documents of one range of ids, in ascending order.  Their token ids form one sequence, cut into chunks of a
fixed size.  A chunk is transposed into planes (all lowest bytes or bits, then the next ...), planes that hold only zeros are left out, and
each is compressed with zstandard.  A footer has the chunk index (the place and size of each plane) and the documents (id, number of tokens), so that
a reader can seek to any token.

    "VSP1" | planes of all chunks | footer, compressed | footer's length (8 bytes) | "VSP1"

Files are written to a new name and then moved, so a task that runs again, or twice at once, leaves one whole file.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import written
from ._words import Block, blocks, give_back, take
from .bpe import Memory, _distinct, gather

MAGIC = b"VSP1"
CHUNK = 1 << 16
#: Stands between words in what the library encodes; a piece of its own that is one token.
_MARK = "\x01"


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The planes of a chunk of ids (uint32), lowest first, up to the highest that isn't all zero."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(-(-top // 8))]
    bits = np.unpackbits(raw[:, : -(-top // 8)], axis=1, bitorder="little") if top else np.zeros((len(ids), 0), np.uint8)
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if unit == "byte":
        for k, x in enumerate(planes):
            raw[:, k] = np.frombuffer(x, np.uint8)
    elif planes:
        bits = np.zeros((n, -(-len(planes) // 8) * 8), np.uint8)
        for k, x in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little")
        raw[:, : bits.shape[1] // 8] = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


class Writer:
    """Writes one file; holds one chunk of ids, and the counts of its documents."""

    def __init__(self, sink, unit: str = "byte", chunk: int = CHUNK, level: int = 1):
        self.sink, self.unit, self.chunk = sink, unit, chunk
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.index: list[dict] = []
        self.docs: list[tuple] = []
        self.tokens = 0
        self.at = self.sink.write(MAGIC)

    def add(self, docs: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.extend(zip(docs, counts.tolist()))
        self.tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.chunk:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.chunk * self.chunk
            for k in range(0, whole, self.chunk):
                self._put(flat[k : k + self.chunk])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(x) for x in to_planes(ids.astype("<u4"), self.unit)]
        self.index.append({"at": self.at, "n": len(ids), "planes": [len(x) for x in planes]})
        for x in planes:
            self.at += self.sink.write(x)

    def close(self) -> None:
        if self.n_held:
            self._put(np.concatenate(self.held))
        foot = self.zip.compress(json.dumps({"unit": self.unit, "chunk": self.chunk, "tokens": self.tokens, "chunks": self.index, "docs": self.docs}).encode())
        self.sink.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        self.sink.close()


class Reader:
    """Reads a file that can seek."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2)
        size = source.tell() if size is None else size
        source.seek(size - 12)
        tail = source.read(12)
        if tail[8:] != MAGIC:
            raise ValueError("not a whole token file")
        n = int.from_bytes(tail[:8], "little")
        source.seek(size - 12 - n)
        self.foot = json.loads(zstandard.ZstdDecompressor().decompress(source.read(n)))
        self.unzip = zstandard.ZstdDecompressor()

    def chunk(self, k: int) -> np.ndarray:
        x = self.foot["chunks"][k]
        self.source.seek(x["at"])
        return from_planes([self.unzip.decompress(self.source.read(m)) for m in x["planes"]], x["n"], self.foot["unit"])

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Any run of tokens, by way of the chunk index."""
        size = self.foot["chunk"]
        parts = [self.chunk(k) for k in range(start // size, -(-(start + n) // size))]
        return np.concatenate(parts)[start % size : start % size + n] if n else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """(id, start within the file, ids) of each document; at most its own chunks are held."""
        at, held, base, k = 0, np.zeros(0, np.uint32), 0, 0
        for doc, n in self.foot["docs"]:
            if base + len(held) < at + n:
                parts = [held[at - base :]]
                got = len(parts[0])
                while got < n:
                    parts.append(self.chunk(k))
                    got += len(parts[-1])
                    k += 1
                held, base = np.concatenate(parts), at
            yield doc, at, held[at - base : at - base + n]
            at += n


class LibraryEncoder:
    """Ids by the ``tokenizers`` library: each distinct word is encoded once and remembered within a bound.

    White space only separates words for this kind of tokenizer, so a text's ids are those of its words in order.
    """

    def __init__(self, path_or_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(path_or_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark = self._ids(_MARK)
        if len(self.mark) != 1 or self._ids(f"a {_MARK} b") != [*self._ids("a"), *self.mark, *self._ids("b")]:
            raise ValueError("this tokenizer's words aren't separate")
        self.ends = self._piece_ends(path_or_json)
        self.memory = Memory(800_000)

    def _piece_ends(self, spec: str) -> np.ndarray | None:
        """Which ids end a piece, where the model marks these ends for every byte."""
        from tokenizers.pre_tokenizers import ByteLevel

        model = json.loads(spec)["model"]
        suffix, vocab = model.get("end_of_word_suffix"), self.tokenizer.get_vocab()
        if model.get("type") != "BPE" or not suffix or any(c + suffix not in vocab for c in ByteLevel.alphabet()):
            return None
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        return ends

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = np.array([t.isalpha() for t in texts], bool) if self.ends is not None else np.zeros(len(texts), bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        cut = int(plain.sum())
        parts = [self._plain([texts[i] for i in order[:cut].tolist()]), self._marked([texts[i] for i in order[cut:].tolist()])]
        flat, n = (np.concatenate(x) for x in zip(*parts))
        at, size = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        at[order], size[order] = np.cumsum(n) - n, n
        return gather(flat, at, size), size

    def _batches(self, texts: list[str], between: str) -> Iterator[tuple[list[str], np.ndarray]]:
        """Runs of texts, joined, with the ids of each run."""
        step, slab = 512, 1 << 15
        for a in range(0, len(texts), slab):  # the library's results are large, so few are held at once
            runs = [texts[k : k + step] for k in range(a, min(a + slab, len(texts)), step)]
            got = self.tokenizer.encode_batch_fast([between.join([*run, ""]) for run in runs], add_special_tokens=False)
            for run, x in zip(runs, got):
                yield run, np.array(x.ids, np.int32)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters, each of which is one piece as a rule: a run with as many ends of pieces as words needs no marks, others get them."""
        parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for run, ids in self._batches(texts, " "):
            ends = np.flatnonzero(self.ends[ids])
            n = np.diff(ends, prepend=-1)
            if len(n) != len(run) or ends[-1] != len(ids) - 1:
                ids, n = self._marked(run)
            parts.append(ids)
            sizes.append(n)
        return np.concatenate(parts), np.concatenate(sizes)

    def _marked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Any words, with a mark after each; those that hold the mark itself are encoded alone."""
        apart = {i for i, t in enumerate(texts) if _MARK in t}
        some = [t if i not in apart else "" for i, t in enumerate(texts)] if apart else texts
        flat = np.concatenate([np.zeros(0, np.int32), *(ids for _, ids in self._batches(some, f" {_MARK} "))])
        ends = np.flatnonzero(flat == self.mark[0])
        n = np.diff(ends, prepend=-1) - 1
        flat = flat[flat != self.mark[0]]
        if apart:
            each = np.split(flat, np.cumsum(n)[:-1])
            for i in apart:
                each[i] = np.array(self._ids(texts[i]), np.int32)
            flat, n = np.concatenate(each), np.array([len(x) for x in each])
        return flat, n.astype(np.int64)

    def block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets into them)."""
        starts, lengths, hashes, inverse, bounds = _distinct(block)
        seen = self.memory.find(hashes)
        miss, hit = np.flatnonzero(seen < 0), np.flatnonzero(seen >= 0)
        raw = block.data.tobytes()
        ids, n = self.words([raw[s : s + m] for s, m in zip(starts[miss].tolist(), lengths[miss].tolist())])
        at, size = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        at[hit], size[hit] = self.memory.at[seen[hit]], self.memory.n[seen[hit]]
        at[miss], size[miss] = len(self.memory.pool) + np.cumsum(n) - n, n
        pool = np.concatenate([self.memory.pool, ids])
        self.memory.add(hashes[miss], ids, n)
        each = size[inverse]
        return gather(pool, at[inverse], each), np.concatenate([[0], np.cumsum(each)])[bounds]


_ENCODERS: dict[str, LibraryEncoder] = {}


def _write(spec: str, folder: str, end: int, unit: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if spec not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[spec] = LibraryEncoder(spec)
        encoder, writer = _ENCODERS[spec], None
        encoder.memory = Memory(800_000)
        fs, base = pafs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        final, draft = f"{base}/{shard:08d}.vsp", f"{base}/.{shard:08d}-{uuid.uuid4().hex}"
        for block in blocks(batches, "_text", 4 << 20):
            if writer is None:
                fs.create_dir(base, recursive=True)
                writer = Writer(fs.open_output_stream(draft), unit, chunk)
            ids, off = encoder.block(block)
            n = np.diff(off) + 1
            out = np.full(int(n.sum()), end, np.uint32)
            body = np.ones(len(out), bool)
            body[np.cumsum(n) - 1] = False
            out[body] = ids
            writer.add(take(block, ["_id"])[0].to_pylist(), n, out)
        encoder.memory = Memory(0)
        give_back()
        if writer is not None:
            writer.close()
            fs.move(draft, final)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, f"{shard:08d}.vsp", len(writer.docs), writer.tokens)], names=["shard", "file", "docs", "tokens"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, unit: str = "byte", chunk: int = CHUNK) -> DataFrame:
    """Encode texts with the ``tokenizers`` file ``tokenizer`` (no specials), append ``end`` to each, and write files into ``folder`` (a URI) in
    ascending order of id.  Returns the manifest: (shard, file, docs, tokens), a row per file.

    Null text counts as empty: its document is the end id alone.  Null ids come first; rows that share an id follow in the order of their text.
    An empty table gives no file and an empty manifest.  Other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    parts = max(1, docs.rdd.getNumPartitions())
    ranged = src.repartitionByRange(parts, F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")
    return written(ranged.mapInArrow(_write(spec, f"{folder}/ids", end, unit, chunk), "shard long, file string, docs long, tokens long"), folder, "manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)

        def rows(held: list) -> pa.RecordBatch:
            cols = list(zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["_id", "start", "n_tokens", "ids"])

        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/{file}") as source:
                    held, size = [], 0
                    for doc, at, ids in Reader(source).documents():
                        held.append((doc, first + at, len(ids), ids.tobytes()))
                        size += len(ids)
                        if size > 1 << 20:
                            yield rows(held)
                            held, size = [], 0
                    if held:
                        yield rows(held)

    return run


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col long, start long, n_tokens long, ids binary: little-endian unsigned 32-bit) of every document in the files of ``folder``.

    ``start`` counts the tokens of all documents before it.  The driver reads one manifest row per file.
    """
    files = spark.read.schema("shard long, file string, docs long, tokens long").parquet(f"{folder}/manifest").orderBy("shard").collect()
    base, rows = 0, []
    for f in files:
        rows.append((f.file, base))
        base += f.tokens
    todo = spark.createDataFrame(rows, "file string, first long").repartition(max(1, len(rows)))
    return todo.mapInArrow(_read(f"{folder}/ids"), "_id long, start long, n_tokens long, ids binary").withColumnRenamed("_id", id_col)
