"""Every query with SQL, on the smallest tables, against DuckDB."""

import math
import re
from difflib import SequenceMatcher

import duckdb
import pytest

from veldspar.functions.lexicons import SCENARIOS
from veldspar.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int | float) or type(v).__name__ == "Decimal":
        return None if isinstance(v, float) and math.isnan(v) else float(v)
    return str(v)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * max(1.0, abs(a))
    return a == b


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    key = lambda row: tuple((str(type(x)), round(x, 4) if isinstance(x, float) else str(x)) for x in row)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=key)
    cur = duck.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(all(map(close, a, b)) for a, b in zip(got, want))


def rows(spark, name):
    return registry.QUERIES[name](spark, FOLDER).collect()


def test_queries_without_sql_are_all_tested():
    assert set(registry.QUERIES) - set(registry.SQL) == {"page_texts", "page_link_counts", "title_ratio_pairs", "adjudicated_actors", "out_of_fold_model", "monte_carlo", "pair_signals", "title_collisions", "page_title_pairs", "model_to_weights", "kernel_model"}


def test_pages(spark, duck):
    """Every page has a row; links are those of its anchors, as a pattern finds them."""
    pages = dict(duck.execute("SELECT page_id, html FROM pages").fetchall())
    texts = {r.page_id: r for r in rows(spark, "page_texts")}
    assert set(texts) == set(pages) and all(r.words > 0 and len(r.text_sha256) == 64 for r in texts.values())
    for r in rows(spark, "page_link_counts"):
        hrefs = re.findall(r"<a\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]*)", re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", pages[r.page_id]), re.I)
        assert 0 <= r.distinct_links <= r.links <= len(hrefs)


def test_title_ratios_equal_brute_force(spark, duck):
    docs = duck.execute(r"SELECT doc_id, lang, trim(regexp_replace(lower(substring(text, 1, 80)), '[^a-z0-9]+', ' ', 'g')) FROM documents ORDER BY 1").fetchall()
    want = {}
    for i, (a, la, x) in enumerate(docs):
        for b, lb, y in docs[i + 1 :]:
            if la == lb and x[:12] == y[:12] and (ratio := SequenceMatcher(None, x, y, autojunk=False).ratio()) >= 0.6:
                want[a, b] = ratio
    got = {(r.id_a, r.id_b): r for r in rows(spark, "title_ratio_pairs")}
    assert set(got) == set(want)
    for key, ratio in want.items():
        assert got[key].ratio == pytest.approx(ratio, abs=1e-6)
        assert got[key].signal == ("near_exact" if ratio >= 0.95 else "high_overlap" if ratio >= 0.8 else "distinct")


def test_pair_signals_equal_brute_force(spark, duck):
    docs = duck.execute(r"SELECT doc_id, lang, trim(regexp_replace(lower(substring(text, 1, 80)), '[^a-z0-9]+', ' ', 'g')), text FROM documents ORDER BY 1").fetchall()
    words = {d[0]: re.findall("[a-z0-9]+", d[3].lower()) for d in docs}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()} for k, w in words.items()}
    want = {}
    for i, (a, la, x, _) in enumerate(docs):
        for b, lb, y, _ in docs[i + 1 :]:
            if la == lb and x[:12] == y[:12]:
                ratio, both = SequenceMatcher(None, x, y, autojunk=False).ratio(), len(sets[a] & sets[b])
                alike = both / union if (union := len(sets[a] | sets[b])) else 0.0
                if ratio >= 0.8 or alike >= 0.25:
                    want[a, b] = "near_exact" if ratio >= 0.95 or alike >= 0.9 else "high_overlap" if ratio >= 0.8 or alike >= 0.6 else "partial_overlap"
    assert {(r.a, r.b): r.signal for r in rows(spark, "pair_signals")} == want
    assert len(set(want.values())) > 1


def test_title_collisions_equal_brute_force(spark, duck):
    groups = {}
    for ending, title in duck.execute(r"SELECT sha256(right(text, 40)), trim(regexp_replace(lower(substring(text, 1, 80)), '[^a-z0-9]+', ' ', 'g')) FROM documents").fetchall():
        groups.setdefault(ending, []).append(title)
    want = {(k, len(t), len(set(t))) for k, t in groups.items() if len(t) >= 3 and any(SequenceMatcher(None, a, b, autojunk=False).ratio() < 0.75 for a in set(t) for b in set(t) if a < b)}
    assert {(r.ending, r["size"], r.titles) for r in rows(spark, "title_collisions")} == want


def test_page_title_pairs_equal_brute_force(spark, duck):
    """Equal titles meet the first page that has them; of different ones, the first pages of each."""
    first, want = {}, {}
    for page, lang, title in duck.execute(r"SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([a-z]{2})/', 1), trim(regexp_replace(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) FROM pages ORDER BY 1").fetchall():
        if title and first.setdefault((lang, title), page) != page:
            want[first[lang, title], page] = "exact_normalised_title"
    stop = {"the", "and", "with", "by"}
    for (la, x), a in first.items():
        for (lb, y), b in first.items():
            if la == lb and a < b:
                r, u, v = SequenceMatcher(None, x, y, autojunk=False).ratio(), set(x.split()) - stop, set(y.split()) - stop
                j = len(u & v) / len(u | v) if u and v else 0.0
                if r >= 0.93 and j >= 0.78:
                    want[a, b] = "very_high_title_similarity" if r >= 0.97 and j >= 0.85 else "high_title_similarity"
    got = {(r.a, r.b): r.signal for r in rows(spark, "page_title_pairs")}
    assert {k: s for k, s in got.items() if "slug" not in s and "cross" not in s} == want


def test_adjudicated_actors(spark, duck):
    """The method follows from how many groups the title names."""
    from veldspar.plans.analysis import ACTORS

    titles = dict(duck.execute(r"SELECT doc_id, substring(regexp_replace(text, '[^\x00-\x7F]', '~', 'g'), 1, 80) FROM documents").fetchall())
    got = rows(spark, "adjudicated_actors")
    assert sorted(r.doc_id for r in got) == sorted(titles)
    for r in got:
        named = [g for g, patterns in ACTORS.items() if any(re.search(p, titles[r.doc_id], re.I | re.A) for p in patterns)]
        if len(named) == 1:
            assert (r.final_group, r.confidence, r.method) == (named[0], 0.95, "third_pass_unique_headline_subject")
        else:
            assert (r.final_group is None) == (r.method == "unresolved_stakeholder_voice_ambiguous") and r.confidence <= 0.94


def test_out_of_fold_model(spark, duck):
    got = {r.row: r for r in rows(spark, "out_of_fold_model")}
    labelled = duck.execute("SELECT count(*) FROM labels l JOIN documents d ON l.doc_id = d.doc_id").fetchone()[0]
    folds = [got[str(k)] for k in range(5)]
    assert sum(r.n for r in folds) == got["mean"].n == got["all"].n == labelled
    assert got["mean"].accuracy == pytest.approx(sum(r.accuracy for r in folds) / 5)


def test_kernel_model(spark, duck):
    got = {r.row: r for r in rows(spark, "kernel_model")}
    n, toxic = duck.execute("SELECT count(*), avg(toxic) FROM labels JOIN documents USING (doc_id)").fetchone()
    folds = [got[str(k)] for k in range(5)]
    assert sum(r.n for r in folds) == got["mean"].n == got["all"].n == n
    assert got["mean"].accuracy == pytest.approx(sum(r.accuracy for r in folds) / 5) and got["all"].accuracy == pytest.approx(sum(r.accuracy * r.n for r in folds) / n)
    assert got["all"].accuracy >= 1 - toxic - 0.1 and 0 <= got["all"].error < 0.3 and got["0"].error is None


def test_model_to_weights_equals_a_loop(spark, duck):
    """The weights that follow from the model's probabilities, voices and relevant documents, by plain sums."""
    from veldspar.functions.lexicons import BASE_WEIGHTS, SIC
    from veldspar.operators import kernel
    from veldspar.plans import flow

    t = registry.Tables(spark, FOLDER)
    d = t.labels.select("doc_id", "quality").join(t.documents.select("doc_id", "text"), "doc_id")
    p = {r.doc_id: r.p for r in kernel.kernel_out_of_fold(d, "doc_id", "text", "quality", stop=flow.STOP_WORDS).collect()}
    voice = {r.doc_id: r.actor for r in rows(spark, "stakeholder_voices")}
    mean = {g: sum(x) / len(x) for g in SIC if (x := [p[i] for i in p if voice[i] == g])}
    share = {}
    for r in flow._matches(t).collect():
        for s, f in flow.RULES:
            share.setdefault((s, f, voice[r.doc_id], r.criterion), []).append(r.matched_sentences >= s and r.families >= f)
    for r in rows(spark, "model_to_weights"):
        e = {g: SIC[g] * (1 - mean[g] if r.mode == "salience_times_contention" else 1) for g in mean if any(k[2] == g for k in share)}
        g = {c: sum(e[a] * sum(x := share[r.s, r.f, a, n]) / len(x) for a in e) / sum(e.values()) for c, n in flow.COUNTED.items()}
        raw = {c: BASE_WEIGHTS[c] * (1 + r.delta * g[c]) for c in BASE_WEIGHTS}
        assert r.pressure == pytest.approx(g[r.criterion], abs=1e-6) and r.weight == pytest.approx(raw[r.criterion] / sum(raw.values()), abs=1e-6)


def test_monte_carlo(spark):
    for r in rows(spark, "monte_carlo"):
        i, q, s = SCENARIOS[r.scenario]
        assert r.n == 10_000 and r.mean == pytest.approx(0.30 * i + 0.35 * q + 0.35 * s, abs=0.002) and r.p05 < r.mean < r.p95
