"""Title pairs through the gram index against every pair."""

import hashlib
import random
import re
from difflib import SequenceMatcher

import pytest

from veldspar.operators.titles import candidate_pairs, least_common, similar_titles

SITES, STOP = ["a.example", "b.example"], ["the", "of"]


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def edited(rng, t, edits):
    for _ in range(edits):
        k = rng.randrange(len(t) + 1)
        t = rng.choice([t[:k] + rng.choice("abc 1é") + t[k:], t[:k] + t[k + 1 :], t[:k] + rng.choice("xyz") + t[k + 1 :], t[k:] + t[:k] if rng.random() < 0.05 else t])
    return t


def titles(rng, n):
    base = ["".join(rng.choice("abcdefgh  ") for _ in range(rng.choice([4, 5, 9, 10, 20, 40, 90]))) for _ in range(n // 5)] + ["aaaaaaaaaaaaaaaaaaaa", "abababababababababab"]
    return [edited(rng, t, rng.randint(0, 5)) for t in base for _ in range(5)]


@pytest.mark.parametrize("least", [0.9, 0.97])
def test_no_pair_is_lost(spark, least):
    rng = random.Random(int(least * 100))
    rows = list({(t, i % 2): (k, str(i % 2), t) for k, (i, t) in enumerate((i, t) for i, t in enumerate(titles(rng, 250)) if t)}.values())
    got = {(r.a, r.b): r.ratio for r in similar_titles(spark.createDataFrame(rows, "id long, block string, title string"), least).collect()}
    want = {(a, b): x for a, p, t in rows for b, q, u in rows if a < b and p == q and (x := ratio(t, u)) >= least}
    assert got == want and len(want) > 10


def test_grams_in_common_are_necessary():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(5, 40)))
        b = edited(rng, a, rng.randint(0, 4))
        grams = [[t[i : i + 3] for i in range(len(t) - 2)] for t in (a, b)]
        both = sum(min(grams[0].count(g), grams[1].count(g)) for g in set(grams[0]))
        assert both >= least_common(len(a) + len(b), ratio(a, b)) - 1e-9


def norm(t):
    return re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()


def signal(x, y):
    (_, ta, ua, ha, ra), (_, tb, ub, hb, rb) = x[:5], y[:5]
    ta, tb = norm(ta), norm(tb)
    host, slug = (lambda u: re.match("https?://(?:www[.])?([^/?#]*)", u).group(1)), (lambda u: norm(re.sub(r"-20\d\d-\d\d-\d\d(-\d+)?$", "", re.sub("[?#].*", "", u.split("://")[1]).strip("/").split("/", 1)[1].split("/")[-1])))
    wa, wb = ({w for w in t.split() if w not in STOP} for t in (ta, tb))
    j = len(wa & wb) / len(wa | wb) if wa and wb else 0.0
    r, s, sites = ratio(ta, tb), ratio(slug(ua), slug(ub)) if slug(ua) and slug(ub) else 0.0, host(ua) in SITES and host(ub) in SITES
    for holds, name in (
        (ra and rb and ha == hb and len(ha) == 64, "same_trusted_hash_requires_metadata_review"), (ta == tb and ta, "exact_normalised_title"), (r >= 0.97 and j >= 0.85, "very_high_title_similarity"),
        (r >= 0.93 and j >= 0.78, "high_title_similarity"), (s >= 0.97 and j >= 0.65, "very_high_slug_similarity"), (sites and r >= 0.9 and j >= 0.75, "cross_site_high_title_similarity"),
    ):
        if holds:
            return name
    return None


def test_signals_equal_every_pair(spark):
    rng, rows = random.Random(6), []
    words = ["the", "report", "of", "mine", "strike", "wages", "annual", "review", "platinum", "belt", "talks", "union"]
    for k in range(40):
        base = [rng.choice(words) + str(n) * (k % 3 == 0) for n in range(rng.choice([3, 6, 9, 16, 22]))]
        for v in range(rng.randint(1, 3)):
            w = list(base)
            if v:
                w[rng.randrange(len(w))] += rng.choice(["s", "", "ed"])
            i = 10 * k + v  # titles differ by their number; slugs are alike
            url = f"http://{rng.choice(['www.', ''])}{rng.choice(['a.example', 'b.example', 'c.example'])}/x/{'-'.join(w)}-about-{k}{'-2012-08-16' * (v % 2)}{rng.choice(['', '/', '?q=1'])}"
            rows.append((i, " ".join(w).title() + (" " * 3 + f"no {i}!" if rng.random() < 0.4 else ""), url, hashlib.sha256(str(i // 7 if rng.random() < 0.2 else i).encode()).hexdigest(), rng.random() < 0.8, str(k % 2)))
    seen, own = set(), []
    for r in rows:  # one row a title, slug and hash here: equal ones are tested below
        keys = {(r[5], norm(r[1])), (r[5], r[3])}
        if not keys & seen:
            seen |= keys
            own.append(r)
    df = spark.createDataFrame(own, "doc long, name string, link string, hash string, fine boolean, year string")
    got = {(r.a, r.b): r.signal for r in candidate_pairs(df, "doc", "year", "name", "link", "hash", "fine", SITES, STOP).collect()}
    want = {(x[0], y[0]): s for x in own for y in own if x[0] < y[0] and x[5] == y[5] and (s := signal(x, y))}
    assert got == want and len(set(want.values())) >= 3


def test_equal_rows_are_paired_with_the_first(spark):
    h = hashlib.sha256(b"x").hexdigest()
    rows = [(i, "Same title", f"http://h{i}.example/{i}", None, True, None) for i in range(5)] + [(10 + i, f"title {'abcdefg'[i] * 9}", "", h, i != 2, None) for i in range(4)] + [(20, None, None, h[:9], True, None), (21, "", None, None, None, "y")]
    df = spark.createDataFrame(rows, "id long, title string, url string, sha string, ready boolean, block string")
    got = sorted((r.a, r.b, r.signal) for r in candidate_pairs(df, "id", "block", "title", "url", "sha", "ready", SITES, STOP).collect())
    assert got == [(0, i, "exact_normalised_title") for i in range(1, 5)] + [(10, i, "same_trusted_hash_requires_metadata_review") for i in (11, 13)]
    assert candidate_pairs(df.limit(0), "id", "block", "title", "url", "sha", "ready", SITES, STOP).count() == 0
