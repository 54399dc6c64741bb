"""Spelling variants against plain loops."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from veldspar.llm.variants import checksums, near_pairs, spelling_variants, subtrie_pairs, variants_sql

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain(rows, times=10):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            n[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    links = {w: [v for v in n if near(v, w)] for w in n}
    form = {w: v for w in n if links[w] and n[v := min(links[w], key=lambda v: (-n[v], v))] >= times * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(links[w]), n.get(form.get(w))) for w in n), key=repr)


def words(rng, letters, count, least=7, most=9):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(count)]


def test_subtries_hold_all_pairs():
    rng = random.Random(3)
    for depth in (0, 2):
        for _ in range(60):
            own = list({"xy"[:depth] + w for w in words(rng, "abé", 25, 0, 5)})
            assert sorted(map(sorted, subtrie_pairs(own, depth))) == [[i, j] for i, j in itertools.combinations(range(len(own)), 2) if near(own[i], own[j])]


def test_checksums_are_put_together():
    rng = random.Random(4)
    texts = [(rng.randbytes(rng.randint(0, 12)), rng.randbytes(rng.randint(0, 64))) for _ in range(200)]
    got = checksums(np.array([zlib.crc32(a) for a, _ in texts], np.uint32), np.array([zlib.crc32(b) for _, b in texts], np.uint32), np.array([len(b) for _, b in texts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in texts]


@pytest.mark.parametrize("most", [4096, 40, 1])
def test_pairs_whatever_the_largest_subtrie(spark, tmp_path, most):
    rng = random.Random(most)
    own = sorted({*words(rng, "ab", 120), *words(rng, "aé×", 60), *("pre" + w for w in words(rng, "ab", 60, 4, 6)), "a" * 40, "a" * 41, "a" * 39 + "b"})
    df = spark.createDataFrame([(w, k) for k, w in enumerate(own)], "word string, n long")
    got = {(r.a, r.an, r.b, r.bn) for r in near_pairs(df, f"file://{tmp_path}", most=most).collect()}
    assert got == {(own[i], i, own[j], j) for i, j in itertools.combinations(range(len(own)), 2) if near(own[i], own[j])}


def corpus():
    rng = random.Random(8)
    base = words(rng, "abcdé", 12)
    rows = [(i, " ".join(rng.choice(base) for _ in range(80))) for i in range(60)]
    rows += [(100 + i, f"{base[0]}x " + f"{base[0]}xy1{base[1]}÷,{base[2].upper()}" * (i < 3)) for i in range(33)]  # a chain of forms, runs cut by digits
    rows += [(None, None), (None, base[3] * 12 + " Ābcdefgh"), (7, ""), (8, "z" * 5000), (9, "z" * 5000), (8, "z" * 5000), (5, "same rows twice"), (5, "same rows twice")]
    return rows


def test_equals_a_plain_count(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "form", 1) for i, t in rows], "doc_id long, text string, word string, n long").repartition(4)
    for most in (4096, 2):
        got = sorted((tuple(r[c] for c in COLUMNS) for r in spelling_variants(df, most=most).collect()), key=repr)
        assert got == plain(rows)
    assert any(r[1] for r in got) and any(r[2] != r[1] for r in got if r[1]), "a form, and a root beyond it"


def test_sql_says_the_same():
    rows = corpus()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.execute(f"CREATE TABLE got AS {variants_sql()}")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM got").fetchall(), key=repr) == plain(rows)


def test_empty_table_and_text_ids(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    rows = [("x-1", "Straßen straßen"), ("x-1", "Straßen"), ("é", "straße straße strassen")]
    got = spelling_variants(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=repr) == plain(rows)
