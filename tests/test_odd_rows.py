"""Queries against their SQL, or against brute force, on rows that the supplied tables lack."""

import random
from difflib import SequenceMatcher

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from veldspar.functions import similarity
from veldspar.operators import dedup, features, shingles, vectors
from veldspar.plans import registry


def documents(folder, texts, langs=None):
    """Documents 0, 1, ... with these texts; all in one language unless ``langs`` has each one's."""
    n = len(texts)
    columns = {"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": langs or ["en"] * n, "source": ["s0"] * n, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(columns), f"{folder}/documents.parquet")
    return str(folder)


def both(spark, name, folder):
    """Sorted rows of a query and of its SQL, in the query's order of columns."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = registry.QUERIES[name](spark, folder)
    key = lambda r: [(x is None, str(type(x)), x or 0) for x in r]
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=key), sorted(want, key=key)


def test_sentence_units_of_digits_spaces_and_control_characters(spark, tmp_path):
    """A sentence that begins or ends with the digit of its place, spaces beyond ASCII, separators that only one engine takes for white space, a null text."""
    x = "x" * 24
    texts = [f"0{x}. {x}1", f"{x}.\x0b{x}", f" {x}　", f"  {x}y ", f"{x}y ", f"{x}.\x01{x}y", f"{x}y\r\n{x}y", f"{x}y!\x0c {x}y", "", None]
    got, want = both(spark, "sentence_units", documents(tmp_path, texts))
    assert got == want
    assert got[0] == (0, 2, 51)


def test_sequence_ratios_equal_difflib():
    r = random.Random(4)
    some = ["", "a", "é" * 300 + "abc" * 100, "ab" * 200, "\ud800x", "\U0001f600x\U0001f600y", "".join(chr(300 + i % 400) for i in range(900))]
    pairs = [(x, y) for x in some for y in some] + [tuple("".join(r.choice("abc ") for _ in range(r.randrange(40))) for _ in "ab") for _ in range(300)]
    want = [SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in pairs]
    a, b = zip(*pairs)
    assert list(similarity.sequence_ratios(a, b)) == want
    assert list(similarity.sequence_ratios(a, b, 0.6)) == [w if w >= 0.6 else 0 for w in want]


def test_title_pairs_of_several_cells(spark, monkeypatch):
    """Titles that are repeated, in blocks of many cells; pairs go by the ids of rows, not of titles."""
    monkeypatch.setattr(dedup, "TITLES", 3)
    r = random.Random(5)
    titles = ["".join(r.choice("ab ") for _ in range(r.randrange(3, 9))) for _ in range(12)]
    rows = [(k, r.choice(["x", "y", None]), r.choice([*titles, None])) for k in range(90)]
    got = {(x.a, x.b): x.ratio for x in dedup.title_pairs(spark.createDataFrame(rows, "id long, block string, title string"), "id", "block", "title", 0.6).collect()}
    want = {}
    for a, p, x in rows:
        for b, q, y in rows:
            if a < b and p == q and None not in (p, x, y) and (ratio := SequenceMatcher(None, x, y, autojunk=False).ratio()) >= 0.6:
                want[a, b] = ratio
    assert got == want and any(v < 1 for v in want.values())


def test_block_jaccard_of_several_cells_and_empty_sets(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SETS", 4)
    r = random.Random(6)
    rows = [(k, r.choice(["x", "y", None]), r.choice([None, [], *([r.sample(range(12), r.randrange(1, 6)) for _ in range(6)])])) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, block string, t array<long>")
    want = {(a, b): len({*s} & {*u}) / len({*s} | {*u}) if s or u else 1.0 for a, p, s in rows for b, q, u in rows if a < b and p == q and None not in (p, s, u)}
    assert {(x.a, x.b): x.jaccard for x in dedup.block_jaccard(df, "id", "block", "t").collect()} == want
    some = {(a, b): v for (a, b), v in want.items() if v >= 0.25 and rows[a][2]}
    assert {(x.a, x.b): x.jaccard for x in dedup.block_jaccard(df, "id", "block", "t", 0.25).collect()} == some


def test_blocks_without_a_language_or_text_have_no_pairs(spark, tmp_path):
    texts = ["The same beginning of a text, one", "The same beginning of a text, two", None, None, "", "the and", "The same beginning of a text, one", "The same beginning of a text, three"]
    folder = documents(tmp_path, texts, ["en", "en", "en", "en", "de", "de", None, None])
    for name in ("blocked_token_jaccard", "blocked_title_pairs"):
        got, want = both(spark, name, folder)
        assert got == want
    assert {(r.a, r.b) for r in registry.QUERIES["pair_signals"](spark, folder).collect()} == {(0, 1)}
    assert {(r.id_a, r.id_b) for r in registry.QUERIES["title_ratio_pairs"](spark, folder).collect()} == {(0, 1)}


def test_block_pairs_of_several_blocks_equal_brute_force(spark, monkeypatch, tmp_path):
    """Blocks that meet, groups of terms that collide, terms of one row only, and a table without rows."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    r, rows = random.Random(7), []
    for k in range(70):
        t = sorted(r.sample(range(1, 30), 4) if k % 3 else rows[k - 3][1] if k > 3 and len(rows[k - 3][1]) == 4 else [1, 2, 3, 600])
        w = [r.random() + 0.1 for _ in t]
        rows.append((k, t, [x / sum(y * y for y in w) ** 0.5 for x in w]))
    rows.append((70, [0], [1.0]))
    df = spark.createDataFrame(rows, "id long, t array<int>, w array<double>")
    dot = lambda x, y: sum(v * dict(zip(*y[1:])).get(t, 0.0) for t, v in zip(*x[1:]))
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and dot(x, y) >= 0.8}
    got = [(p.a, p.b) for p in vectors.block_pairs(df, f"file://{tmp_path}", 0.8, 1).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert vectors.block_pairs(df.where("id < 0"), f"file://{tmp_path}/none", 0.8).count() == 0


def test_terms_without_rare_ones_weigh_the_same(spark):
    """Buckets leave out pairs that are too rare, and nothing of the most used terms; ties and terms of nearly all rows included."""
    r = random.Random(8)
    rows = [(k, " ".join(r.choices("abcdefghijklmnop", range(1, 17), k=12)) + " all") for k in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    whole, part = (features.terms(df, "id", "text", bigrams=True, top=top) for top in (None, 9))
    weights = [{(x.id, x.term): round(x.w, 9) for x in features.tfidf(tf, len(rows), features=9).collect()} for tf in (whole, part)]
    assert weights[0] == weights[1] and part.count() < whole.count() / 2


def test_shingle_pairs_of_divided_blocks_equal_the_sql(spark, monkeypatch, tmp_path):
    """Blocks in several parts, groups and cells, copies, shared lines, short and odd texts; texts without a language are no pairs."""
    for name, value in (("HEAVY", 400), ("GROUP", 900), ("_BYTES", 300)):
        monkeypatch.setattr(shingles, name, value)
    monkeypatch.setattr(dedup, "SETS", 6)
    monkeypatch.setattr(dedup, "RARE", 9)
    monkeypatch.setattr(dedup, "PAIRS", 7)
    r, texts = random.Random(8), [None, "", "The", "the end", "THE END!", "été the", "the é two été", "the end", "the   end"]
    for k in range(90):
        words = [r.choice("abcdefgh") + str(r.randrange(9)) for _ in range(r.choice([3, 4, 5, 6, 20, 60]))]
        if k % 3 and len(texts) > 20:
            words = r.choice(texts[12:20]).split()[1:]
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = "x" + str(k)
        texts.append(" ".join([r.choice(["the", "The", "a"]), *words, *("one line that all of some have in common".split() if k % 5 == 0 else [])]))
    texts += [texts[12], "same text of no language at all"] * 2
    folder = documents(tmp_path, texts, [*(r.choice(["en", "en", "en", "de"]) for _ in texts[:-4]), None, None, None, None])
    got, want = both(spark, "shingle_pairs", folder)
    assert got == want and len(got) > 15


def test_only_sets_that_may_have_a_pair_are_dealt_whole(spark):
    texts = [(k, f"same start {' '.join(f'w{k}x{j}' for j in range(40))}") for k in range(200)] + [(200, "same start one two three four five six"), (201, "same start one two three four five six seven")]
    df = spark.createDataFrame(texts, "id long, t string")
    held = []
    whole = shingles.block_jaccard
    try:
        shingles.block_jaccard = lambda d, *a: held.append({x.id for x in d.collect()}) or whole(d, *a)
        got = shingles.shingle_jaccard(df, "id", F.lit("b"), "t", 0.6).collect()
    finally:
        shingles.block_jaccard = whole
    assert [(x.a, x.b, round(x.jaccard, 6)) for x in got] == [(200, 201, 0.8)]
    assert {200, 201} <= held[0] and len(held[0]) < 10
