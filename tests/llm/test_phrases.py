"""Phrase collocations against a plain count of everything."""

import random
import re
from collections import Counter

import duckdb
import pytest

from veldspar.llm import phrases
from veldspar.llm.phrases import collocations, collocations_sql, count_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    return f, total


def plain(rows, least, top):
    f, total = counts(rows)
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least or any(lang == lg and len(x) > len(w) and b >= least and 100 * b >= 80 * a and any(x[i : i + len(w)] == w for i in range(len(x))) for (lg, x), b in f.items()):
            continue
        score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, le, r, total[lang], -s) for lang, x in out.items() for rank, (s, a, p, le, r) in enumerate(sorted(x)[:top], 1))


def text(rng, n=60):
    return "".join(rng.choice(["a", "b", "C", "dé", "É", "ee", "Fff", "\x00g", "你", "a-b"]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!? "]) for _ in range(n))


ROWS = [("en", "x y z w " * 9), (None, "null lang null lang"), ("und", "Null Lang"), ("en", None), ("en", ""), ("de", " \t\n..")]


@pytest.mark.parametrize("buckets", [64, 1 << 17])
def test_equals_a_plain_count(spark, buckets):
    rng = random.Random(buckets)
    rows = ROWS + [(rng.choice(["en", "de", "en", None]), text(rng)) for _ in range(40)]
    df = spark.createDataFrame([(lang, t, "phrase", 3) for lang, t in rows], "lang string, text string, phrase string, rank int").repartition(5)
    for least, top in ((3, 2000), (2, 7)):
        got = collocations(df, least=least, top=top, buckets=buckets).collect()
        assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == plain(rows, least, top)


def test_counts_of_all_lengths_and_many_flushes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_FLUSH", 5)
    rng = random.Random(1)
    rows = [("en", text(rng, 30)) for _ in range(30)]
    grams, words = count_phrases(spark.createDataFrame(rows, "lang string, text string"), least=4)
    f, total = counts(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in grams.collect()} == {k: n for k, n in f.items() if n >= 4}
    assert {r.lang: r.n for r in words.collect()} == dict(total)


def test_a_threshold_beyond_a_byte(spark):
    rows = [("en", "one two three " * 400), ("en", "one two")]
    assert {r.phrase: r.f for r in count_phrases(spark.createDataFrame(rows, "lang string, text string"), least=400)[0].where("m > 1").collect()} == {"one two": 401, "two three": 400, "one two three": 400}


def test_sql_says_the_same(spark):
    rng = random.Random(9)
    rows = ROWS + [("fr", text(rng)) for _ in range(20)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(collocations_sql(least=3, top=50)).fetchall()) == plain(rows, 3, 50)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
