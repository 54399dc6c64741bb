"""BPE encoding and decoding: a minimal acyclic transducer for frequent words, exact merges for the rest.

The words that the whole corpus uses most are compiled into a minimal acyclic automaton with shared prefixes and
suffixes.  Its transitions carry numbers whose sum along a word is the word's place in the table of outputs, that is, of id
sequences.  The file goes to every executor with ``addFile`` and is memory-mapped there.  Each block of documents is reduced
to its distinct words; all of them walk the automaton in step, as numpy arrays.  Words that it lacks are normalised, split and merged
exactly, again many at a time.  The result is the tokenizer's own, whatever the lexicon holds.
"""

from __future__ import annotations

import heapq
import json
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared_dir, written
from ._words import Block, blocks, give_back, hash_spans, split_words, take

#: Distinct words with outputs in the lexicon.
LEXICON = 1 << 16
#: Longer words don't enter the lexicon.
LONGEST = 64
#: Pieces of more bytes are merged one by one, with a heap of their pairs.
ALONE = 512
_END = "</w>"
_INF = np.int32(1 << 30)
#: Words with characters beyond Latin scripts are cut by the library.
_FAR = regex.compile("[^\\x00-\u024f]")
_ARRAYS = ("keys", "to", "add", "final", "offsets", "ids")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level tokenizers: Latin-1 characters that print
    stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The elements of ``data`` in the spans, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class WordBpe:
    """The tokenizer of a ``tokenizers`` file of the kind: NFC, white space, lower case; a pattern; byte-level BPE with word ends."""

    def __init__(self, path: str):
        self.spec, self.library = Path(path).read_text(encoding="utf-8"), None
        spec = json.loads(self.spec)
        vocab: dict[str, int] = spec["model"]["vocab"]
        if spec["model"]["end_of_word_suffix"] != _END or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("another kind of tokenizer")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.lines = regex.compile("\n|" + self.pattern.pattern)
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        chars = _byte_chars()
        self.plain = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + _END] for c in chars], np.int32)
        self.size = max([*vocab.values(), *added.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.by_pair: dict[int, int] | None = None
        self.bits = 18
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _INF, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.slots[slot] >= 0:
                slot = (slot + 1) % len(self.slots)
            self.slots[slot], self.ranks[slot] = key, rank
        names = sorted({**vocab, **added}.items(), key=lambda x: x[1])
        raw = [b""] * self.size
        for name, k in names:
            raw[k] = name.encode()
        self.token_len = np.array([len(x) + 1 for x in raw], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(x + b" " for x in raw), np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """The place of each pair among the merges."""
        slot = self._slot(keys)
        got = self.slots[slot]
        out = np.where(got == keys, self.ranks[slot], _INF)
        left = np.flatnonzero((got != keys) & (got >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.slots)
            got = self.slots[slot[left]]
            same = got == keys[left]
            out[left[same]] = self.ranks[slot[left[same]]]
            left = left[~same & (got >= 0)]
        return out

    def merge(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each word's ids, number of them) for words that are one piece of the pattern each."""
        size = np.array([len(w) for w in words], np.int64)
        start, count, flat, done = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
        order = np.argsort(size, kind="stable")
        at, many = np.searchsorted(size[order], [1, ALONE + 1]).tolist()
        for i in order[many:].tolist():
            got = self._merge_alone(words[i])
            start[i], count[i], done = done, len(got), done + len(got)
            flat.append(got)
        while at < many:
            width = int(size[order[at]])
            to = min(many, int(np.searchsorted(size[order], max(width + 1, width * 5 // 4), "right")))
            to = min(to, at + max(1, (1 << 21) // max(1, int(size[order[to - 1]]))))
            rows = order[at:to]
            n = size[rows]
            m = np.full((len(rows), int(n.max())), -1, np.int32)
            data = np.frombuffer(b"".join(words[i] for i in rows.tolist()), np.uint8)
            m[np.arange(m.shape[1]) < n[:, None]] = self.plain[data]
            m[np.arange(len(rows)), n - 1] = self.last[data[np.cumsum(n) - 1]]
            self._merge(m)
            count[rows] = c = (m >= 0).sum(1)
            start[rows] = done + np.cumsum(c) - c
            done += int(c.sum())
            flat.append(m[m >= 0])
            at = to
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), start, count

    def _merge(self, m: np.ndarray) -> None:
        """Merge within each row of ``m``, in place; rows end in -1."""
        live = np.arange(len(m))
        cols = np.arange(m.shape[1])
        cur, ranks = m, self._pair_ranks(m)
        while cur.shape[1] > 1 and len(live):
            col = ranks.argmin(1)
            best = ranks[np.arange(len(live)), col]
            go = best < _INF
            if not go.all():
                m[live] = np.pad(cur, ((0, 0), (0, m.shape[1] - cur.shape[1])), constant_values=-1)
                live, cur, ranks, col, best = live[go], cur[go], ranks[go], col[go], best[go]
                if not len(live):
                    break
            shifted = np.concatenate([cur[:, 1:], np.full((len(cur), 1), -1, np.int32)], 1)
            cur = np.where(cols[: cur.shape[1]] <= col[:, None], cur, shifted)
            cur[np.arange(len(live)), col] = self.new[best]
            moved = np.concatenate([ranks[:, 1:], np.full((len(ranks), 1), _INF, np.int32)], 1)
            ranks = np.where(cols[: ranks.shape[1]] <= col[:, None], ranks, moved)
            rows = np.arange(len(live))
            for c in (col - 1, col):  # only the pairs beside the new token change
                ok = (c >= 0) & (c < ranks.shape[1])
                r, c = rows[ok], c[ok]
                ranks[r, c] = self._pairs(cur[r, c], cur[r, c + 1])
        if len(live):
            m[live] = np.pad(cur, ((0, 0), (0, m.shape[1] - cur.shape[1])), constant_values=-1)

    def _merge_alone(self, word: bytes) -> np.ndarray:
        """The same for one long piece, in time that grows with its length and hardly more: neighbours are linked, and a heap names the next pair."""
        if self.by_pair is None:
            used = self.slots >= 0
            self.by_pair = dict(zip(self.slots[used].tolist(), self.ranks[used].tolist()))
        data = np.frombuffer(word, np.uint8)
        ids = self.plain[data]
        ids[-1] = self.last[data[-1]]
        n, size, rank, new = len(ids), self.size, self.by_pair, self.new.tolist()
        first = self._pairs(ids[:-1], ids[1:]).astype(np.int64)
        live = np.flatnonzero(first < _INF)
        heap = (first[live] << 32 | live).tolist()  # the lowest rank first, and the leftmost of equal ones
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heapq.heappop(heap)
            r, k = top >> 32, top & 0xFFFFFFFF
            to = after[k]
            if ids[k] < 0 or to >= n or rank.get(ids[k] * size + ids[to]) != r:
                continue  # one of the two has been merged since
            ids[k], ids[to] = new[r], -1
            after[k] = to = after[to]
            if to < n:
                before[to] = k
                if (r := rank.get(ids[k] * size + ids[to])) is not None:
                    heapq.heappush(heap, r << 32 | k)
            if (b := before[k]) >= 0 and (r := rank.get(ids[b] * size + ids[k])) is not None:
                heapq.heappush(heap, r << 32 | b)
        out = np.array(ids, np.int32)
        return out[out >= 0]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        return np.where((a >= 0) & (b >= 0), self.rank(key.ravel()).reshape(key.shape), _INF).astype(np.int32)

    def _pair_ranks(self, m: np.ndarray) -> np.ndarray:
        return self._pairs(m[:, :-1], m[:, 1:])

    def _pieces(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        return self.lines.findall("".join(c.lower() for c in text) if "\u03a3" in text else text.lower())

    def pieces(self, text: str) -> list[str]:
        """The pieces that merge on their own, and each line feed; a special token is a piece."""
        if self.special and self.special.search(text):
            return [y for x in self.special.split(text) for y in ([x] if x in self.added else self._pieces(x))]
        return self._pieces(text)

    def library_pieces(self, text: str) -> list[str]:
        """Pieces as the tokenizers library cuts them: its Unicode tables may be of another version than Python's."""
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self.library = Tokenizer.from_str(self.spec).normalizer, pre_tokenizers.Split(Regex(self.pattern.pattern), "removed", invert=True)
        normal, split = self.library
        parts = self.special.split(text) if self.special else [text]
        return [y for x in parts if x for y in ([x] if x in self.added else [p for p, _ in split.pre_tokenize_str(normal.normalize_str(x))])]

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each) for words without ASCII white space."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        codes: dict[str, int] = {"\n": 0}
        text = b"\n".join(words).decode("utf-8", "replace")
        far = {k: self.library_pieces(w) for k, w in enumerate(text.split("\n")) if _FAR.search(w)} if _FAR.search(text) else {}
        if far:
            text = "\n".join("" if k in far else w for k, w in enumerate(text.split("\n")))
        seq = np.array([codes.setdefault(x, len(codes)) for x in self.pieces(text)], np.int64)
        word = np.cumsum(seq == 0)
        if far:
            more = [codes.setdefault(x, len(codes)) for p in far.values() for x in p]
            seq, word = np.concatenate([seq, np.array(more, np.int64)]), np.concatenate([word, np.repeat(np.array(list(far)), [len(p) for p in far.values()])])
            order = np.argsort(word, kind="stable")
            seq, word = seq[order], word[order]
        flat, at, size = self.merge([b"" if x in self.added or x == "\n" else x.encode("utf-8", "replace") for x in codes])
        for x, k in self.added.items():
            if (code := codes.get(x)) is not None:
                at[code], size[code], flat = len(flat), 1, np.append(flat, np.int32(k))
        return gather(flat, at[seq], size[seq]), np.bincount(word, size[seq], len(words)).astype(np.int64)

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, row offsets) of the texts of rows of ids: their tokens, joined by a space."""
        size = self.token_len[ids]
        data = gather(self.token_bytes, self.token_at[ids], size)
        ends = np.concatenate([[0], np.cumsum(size)])[offsets]
        # each row's last token is followed by a space too many
        keep = np.ones(len(data), bool)
        keep[ends[1:][np.diff(offsets) > 0] - 1] = False
        gone = np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        return data[keep], ends - gone


def compile_lexicon(words: Sequence[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of distinct words, with numbers on its transitions: their sum along a word is its place
    in the sorted order."""
    register: dict[tuple, int] = {}
    edges: list[list[tuple[int, int]]] = []
    finals: list[bool] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(edges)
            edges.append(node[1])
            finals.append(node[0])
        return register[key]

    path: list[list] = [[False, []]]  # of the last word: [final, settled transitions]
    before = b""
    for word in [*sorted(words), None]:
        same = 0
        if word is not None:
            while same < min(len(word), len(before)) and word[same] == before[same]:
                same += 1
        while len(path) - 1 > same:
            child = path.pop()
            path[-1][1].append((before[len(path) - 1], settle(child)))
        if word is not None:
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            before = word
    settle(path[0])
    below: list[int] = []  # words that start at a state; children come before their parents
    keys, to, add = [], [], []
    for k, (final, out) in enumerate(zip(finals, edges)):
        n = int(final)
        for byte, child in out:
            keys.append(k << 8 | byte)
            to.append(child)
            add.append(n)
            n += below[child]
        below.append(n)
    return {"keys": np.array(keys, np.int64), "to": np.array(to, np.int32), "add": np.array(add, np.int32), "final": np.array(finals, bool)}


def save_lexicon(words: Sequence[bytes], bpe: WordBpe, path: Path) -> None:
    words = sorted(set(words))
    parts = compile_lexicon(words)
    ids, n = bpe.encode_words(words)
    parts |= {"offsets": np.concatenate([[0], np.cumsum(n)]).astype(np.int64), "ids": ids.astype(np.int32)}
    head, at = [], 0
    for name in _ARRAYS:
        head.append({"name": name, "type": parts[name].dtype.str, "n": len(parts[name]), "at": at})
        at += -(-parts[name].nbytes // 8) * 8
    raw = json.dumps(head).encode()
    with path.open("wb") as f:
        f.write(len(raw).to_bytes(8, "little") + raw + b" " * (-len(raw) % 8))
        for name in _ARRAYS:
            f.write(parts[name].tobytes() + b"\0" * (-parts[name].nbytes % 8))


class Lexicon:
    """A saved lexicon, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(raw[:8].tobytes(), "little")
        base = 8 + -(-n // 8) * 8
        for x in json.loads(raw[8 : 8 + n].tobytes()):
            kind = np.dtype(x["type"])
            setattr(self, x["name"], raw[base + x["at"] : base + x["at"] + x["n"] * kind.itemsize].view(kind))
        self.root = len(self.final) - 1

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The output of each word, or -1: all words take a step at a time."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return out
        live = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
        state, total = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 8 | data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at, total = live[ok], at[ok], total[ok]
            state, total = self.to[at].astype(np.int64), total + self.add[at]
            step += 1
            end = lengths[live] == step
            hit = end & self.final[state]
            out[live[hit]] = total[hit]
            live, state, total = live[~end], state[~end], total[~end]
        return out


@lru_cache(1)
def _bpe(name: str) -> WordBpe:
    return WordBpe(SparkFiles.get(name))


@lru_cache(1)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def _distinct(block: Block) -> tuple[np.ndarray, ...]:
    """(starts, lengths, hashes) of the block's distinct words, each word's place among them, words before each row."""
    starts, ends, bounds = split_words(block)
    h, first, inverse = np.unique(hash_spans(block.data, starts, ends), return_index=True, return_inverse=True)
    return starts[first], (ends - starts)[first], h, inverse, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list) -> pa.RecordBatch:
        h, words, n = (np.concatenate([x[0] for x in held]), pa.concat_arrays([x[1] for x in held]), np.concatenate([x[2] for x in held]))
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([words.take(pa.array(first)), pa.array(np.bincount(inverse, n).astype(np.int64))], names=["word", "n"])

    held, size = [], 0
    for block in blocks(batches, "_text", 4 << 20):
        starts, lengths, h, inverse, _ = _distinct(block)
        off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(gather(block.data, starts, lengths))])
        held.append((h, words, np.bincount(inverse, minlength=len(h))))
        size += len(h)
        if size > 500_000:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def frequent_words(docs: DataFrame, text_col: str = "text", size: int = LEXICON) -> list[bytes]:
    """Words of all texts by use: as many whole classes of frequency (a sixteenth of a power of two wide) as hold ``size`` words together.

    The driver gets a row for each class, then these words, and never a partial list of every task.
    """
    counts = docs.select(F.col(text_col).cast("binary").alias("_text")).mapInArrow(_count, "word binary, n long").where(F.length("word") <= LONGEST)
    counts = written(counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("class", F.floor(F.log2("n") * 16).cast("int")), shared_dir(docs.sparkSession), "words")
    least, total = None, 0
    for r in counts.groupBy("class").count().orderBy(F.desc("class")).collect():
        total += r["count"]
        if total > size:
            break
        least = r["class"]
    return [] if least is None else [bytes(r.word) for r in counts.where(F.col("class") >= least).select("word").collect()]


def publish(spark: SparkSession, path: str, words: Sequence[bytes]) -> tuple[str, str]:
    """Send the tokenizer file and a lexicon of ``words`` to the executors; their names there."""
    folder = Path(tempfile.mkdtemp(prefix="veldspar-"))
    tag = uuid.uuid4().hex
    a, b = folder / f"bpe-{tag}.json", folder / f"lexicon-{tag}.bin"
    a.write_bytes(Path(path).read_bytes())
    save_lexicon(words, WordBpe(path), b)
    for x in (a, b):
        spark.sparkContext.addFile(str(x))
    return a.name, b.name


class Memory:
    """Ids of words met before in this task, by hash; it starts anew beyond ``most`` words."""

    def __init__(self, most: int = 700_000):
        self.most = most
        self.hashes, self.at, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def add(self, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > self.most:
            self.__init__(self.most)
        h = np.concatenate([self.hashes, hashes])
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(n) - n])[order]
        self.n = np.concatenate([self.n, n])[order]
        self.pool = np.concatenate([self.pool, ids])


def encode_block(block: Block, bpe: WordBpe, lexicon: Lexicon, memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row offsets into them) of a block of documents."""
    memory = memory or Memory()
    starts, lengths, hashes, inverse, bounds = _distinct(block)
    at, size = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    where = lexicon.find(block.data, starts, lengths)
    hit, miss = np.flatnonzero(where >= 0), np.flatnonzero(where < 0)
    at[hit], size[hit] = lexicon.offsets[where[hit]], lexicon.offsets[where[hit] + 1] - lexicon.offsets[where[hit]]
    seen = memory.find(hashes[miss])
    hit, seen, miss = miss[seen >= 0], seen[seen >= 0], miss[seen < 0]
    at[hit], size[hit] = len(lexicon.ids) + memory.at[seen], memory.n[seen]
    raw = block.data.tobytes()
    ids, n = bpe.encode_words([raw[s : s + m] for s, m in zip(starts[miss].tolist(), lengths[miss].tolist())])
    pool = np.concatenate([lexicon.ids, memory.pool, ids])
    at[miss], size[miss] = len(lexicon.ids) + len(memory.pool) + np.cumsum(n) - n, n
    memory.add(hashes[miss], ids, n)
    per_word = size[inverse]
    return gather(pool, at[inverse], per_word), np.concatenate([[0], np.cumsum(per_word)])[bounds]


def _encode(names: tuple[str, str], decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lexicon, memory = _bpe(names[0]), _lexicon(names[1]), Memory()
        for block in blocks(batches, "_text", 4 << 20):
            ids, off = encode_block(block, bpe, lexicon, memory)
            cols = [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))]
            if decode:
                data, ends = bpe.decode_rows(ids, off)
                cols.append(pa.Array.from_buffers(pa.string(), len(block), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]))
            yield pa.RecordBatch.from_arrays([*take(block, ["_own"]), *cols], names=["_own", "ids", "decoded"][: 2 + decode])
        del memory
        give_back()

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon: int = LEXICON, decode: bool = True) -> DataFrame:
    """(id_col, ids array<int>[, decoded string]), one row per row of ``docs``.

    ``ids`` are those of the ``tokenizers`` file at ``path`` without added specials, truncation or padding; ``decoded`` is what its ``decode``
    gives for them, special tokens kept.  Null text counts as empty: no ids and empty text.  Ids may be null or repeat; rows don't affect each
    other.  Other columns are not read.
    """
    names = publish(docs.sparkSession, path, frequent_words(docs, text_col, lexicon))
    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("_own"), F.col(text_col).cast("binary").alias("_text")).mapInArrow(_encode(names, decode), f"_own {kind}, ids array<int>" + ", decoded string" * decode)
    return got.withColumnRenamed("_own", id_col)
