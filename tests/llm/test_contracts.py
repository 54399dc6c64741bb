"""The registered queries on the smallest tables, each against a plain restatement of its contract; the stages of the pipeline on awkward rows."""

import hashlib
import re
import sys
import zlib
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from veldspar.llm import decontaminate  # noqa: E402
from veldspar.llm.queries import QUERIES, SQL  # noqa: E402

from test_operators import TOKENIZER, base, groups_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in sorted(t, key=lambda r: r["doc_id"])}


def got(spark, name, key="doc_id"):
    rows = QUERIES[name](spark, FOLDER).collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op1(spark, docs):
    rows, start = got(spark, "op1_planes"), 0
    for i, text in docs.items():
        ids = [*TOKENIZER.encode(text, add_special_tokens=False).ids, 1]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids)))
        start += len(ids)


def test_op2(spark):
    turns = sorted(pq.read_table(f"{FOLDER}/conversations.parquet").to_pylist(), key=lambda r: (r["conv_id"], r["turn"]))
    said = "</s>[INST] ok [/INST]"
    convs = {-1: [("user", said), ("assistant", said)]}
    for r in turns:
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    rows = got(spark, "op2_incremental", "conv_id")
    assert set(rows) == set(convs)
    for k, turns in convs.items():
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert (rows[k].n_turns, rows[k].turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)))
        assert (rows[k].loss_chars, rows[k].loss_sha256) == (len(learnt), sha(learnt)) and rows[k].formatted_chars >= len(learnt)


def test_op3(spark, docs):
    rows, ids, prints = got(spark, "op3_parsing"), list(docs), {}
    for k, i in enumerate(ids):
        after = docs[ids[k - 1]] if k else docs[ids[-1]]  # the next one in descending order of ids
        # descending: after the last, that is the smallest id, comes the first, the largest
        text = docs[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), sha(edited)) and 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        assert prints.setdefault(text, rows[i].fingerprint) == rows[i].fingerprint


def test_op4(spark, docs):
    rows, names = got(spark, "op4_grammar"), ("assign", "access", "hex")
    for i, text in docs.items():
        spans = base(text)
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert rows[i].base_sha256 == sha(",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans))
        assert {f"{names[k]}:{s}:{e}" for s, k, e in spans} <= {*rows[i].spans.split(",")}


def test_op5_finds_planted_passages_and_no_others(spark):
    folder = "/root/testdata/sf0.01"
    items = {r["item_id"]: r["text"].lower().split() for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()}
    runs = {}
    for k, words in items.items():
        for a in range(len(words) - 11):
            runs.setdefault(tuple(words[a : a + 12]), set()).add(k)
    want = set()
    for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        words = (r["text"] or "").lower().split()
        want |= {(r["doc_id"], k) for a in range(len(words) - 11) for k in runs.get(tuple(words[a : a + 12]), ())}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op5_latent"](spark, folder).collect()}
    assert len(want) >= 10 and len(want & found) >= 0.99 * len(want) and len(found - want) <= 0.05 * len(found)


def test_op5_blocks_of_items_change_nothing(spark):
    d, b = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {(r.doc_id, r.item_id, round(r.cosine, 4)) for r in decontaminate.find_leaks(d, b).collect()}
    assert {(r.doc_id, r.item_id, round(r.cosine, 4)) for r in decontaminate.find_leaks(d, b, items_at_once=3).collect()} == whole


def test_op6(spark, docs):
    rows = got(spark, "op6_noisy_channel")
    assert set(rows) == set(docs)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op7(spark, docs):
    want = groups_of(list(docs.items()), 4, 80)
    rows = got(spark, "op7_superminhash")
    assert {i: (r.n_shingles, r.component_id) for i, r in rows.items()} == want and all(r.kept == (r.component_id == i) for i, r in rows.items())


def test_op8(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    df = QUERIES["op8_sentence_rules"](spark, FOLDER)
    cur = con.execute(SQL["op8_sentence_rules"])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


def test_op9(spark, docs):
    rows = got(spark, "op9_transducer")
    for i, text in docs.items():
        ids = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), sha(" ".join(map(str, ids)))) and rows[i].decoded_sha256 == sha(TOKENIZER.decode(ids, skip_special_tokens=False))


def test_op10(spark, docs):
    rows, seen = got(spark, "op10_debruijn"), set()
    for i, text in docs.items():
        words = WORD.findall(text)
        gone = [False] * len(words)
        for a in range(len(words) - 19):
            w = tuple(words[a : a + 20])
            if w in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(w)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g)))


def awkward(spark):
    """The columns of documents and one more, with nulls, empty, equal and long texts, and an id that repeats."""
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    long = " ".join(f"word{k % 911} of{k % 53}" for k in range(40_000))
    more = [(None, "null id, some words here", "en", "s", 1), (10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, long, "en", "s", 9), (10_004, long, "en", "s", 9), (10_004, "another text", "en", "s", 9)]
    return d.limit(60).unionByName(spark.createDataFrame(more, d.schema)).withColumn("_id", F.lit("mine")).withColumn("words", F.lit(3))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows_and_no_rows(spark, name):
    stage, src = dict(corpus_pipeline.STAGES)[name], awkward(spark)
    out = stage(spark, src, FOLDER)
    ids = lambda df: sorted(r[0] if r[0] is not None else -1 for r in df.select("doc_id").collect())
    before, after = ids(src), ids(out)
    assert stage(spark, src.limit(0), FOLDER).count() == 0
    if name == "bpe_encoding":
        assert after == before and out.columns == ["doc_id", "n_tokens", "ids"]
        return
    assert out.columns == src.columns and set(after) <= set(before)
    kept = {k for k in before if k not in after}
    if name == "secret_scans":
        assert after == before
    elif name == "minhash_near_dedup":  # of the two long texts one goes, with its id unless another row of the id is kept
        assert {-1, 10_001, 10_002, 10_003} <= set(after)
    else:
        assert {-1, 10_001, 10_002, 10_003, 10_004} <= set(after), kept


def test_pipeline_keeps_clean_documents_and_encodes_them(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert 0.5 * n < len(rows) <= n and len({r.doc_id for r in rows}) == len(rows) and all(r.n_tokens == len(r.ids) for r in rows)
