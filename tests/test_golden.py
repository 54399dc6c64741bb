"""Recorded values, invariants and checks."""

import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from veldspar.functions import similarity, text
from veldspar.functions.lexicons import PLU, SIC
from veldspar.operators import dedup, features, grids, indices, integrity, metrics, rules, stance
from veldspar.sources import frontier, readers, writers


def test_scenario_indices(spark):
    d = F.col("I"), F.col("R"), F.col("S")
    rows = indices.scenarios(spark).select("scenario", indices.pci(*d).alias("p"), indices.rpci_norm(*d).alias("r")).collect()
    assert {r.scenario: (round(r.p, 4), round(r.r, 4)) for r in rows} == {"A": (0.456, 0.4074), "B": (0.665, 0.6251), "C": (0.7815, 0.7423)}


def test_recorded_simulation():
    got = grids.monte_carlo_reference_stream()
    assert [round(float(x.mean()), 4) for x in got.values()] == [0.4560, 0.6650, 0.7817]
    assert [round(float((x >= 0.70).mean()), 4) for x in got.values()] == [0.0, 0.1158, 0.9974]


def test_simulation_agrees_with_the_recorded_one(spark):
    rows = {r.scenario: r for r in grids.monte_carlo(indices.scenarios(spark), 20_000).collect()}
    assert abs(rows["B"]["mean"] - 0.665) < 0.002 and abs(rows["B"].exceeds - 0.1158) < 0.02


def test_sic_values():
    assert all(round(0.3 * p + 0.4 * l + 0.3 * u, 3) == SIC[g] for g, (p, l, u) in PLU.items())


def test_confusion_golden(spark):
    rows = [(0, 0)] * 709 + [(0, 1)] * 21 + [(1, 0)] * 35 + [(1, 1)] * 41
    r = metrics.confusion(spark.createDataFrame(rows, "t int, g int"), "t", "g").first()
    assert [round(x, 6) for x in (r.accuracy, r.balanced_accuracy, r.precision, r.recall, r.f1, r.kappa)] == [0.930521, 0.755353, 0.66129, 0.539474, 0.594203, 0.556638]


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (0, 0.5)]
    assert metrics.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first().auc == pytest.approx(5 / 6)


def test_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([(1, "labour", 2.0), (1, "NGO", 2.0), (1, "community", 1.0)], 'id int, `group` string, score double')
    r = stance.dominant(df, "id").first()
    assert (r.group, r.top, r.second, r.margin) == ("NGO", 2.0, 2.0, 0.0)


def test_adjudication_margin(spark):
    df = spark.createDataFrame([(1.0, -1.0), (0.3, 0.3), (-2.0, -2.0)], "a double, b double")
    rows = df.select(stance.adjudicated(F.col("a"), F.col("b")).alias("d")).select("d.*").collect()
    assert [r.label for r in rows] == [None, 1, 0]


def test_text_functions(spark):
    df = spark.createDataFrame([("A\0b  c\n\nd", "http://WWW.Ex.com//a//b/?q=1#f", "x 2012-13-40 y")], "t string, u string, d string")
    r = df.select(text.norm(F.col("t")).alias("n"), text.canonical_url(F.col("u")).alias("c"), text.date_in(F.col("d")).alias("d"), text.url_candidates(F.col("u"), {"a.org": "b.org"}).alias("m")).first()
    assert (r.n, r.c, r.d) == ("A b c d", "https://ex.com/a/b", None)
    assert r.m == ["http://WWW.Ex.com//a//b/?q=1#f", "https://WWW.Ex.com//a//b/?q=1#f"]


def test_shingles_and_jaccard(spark):
    df = spark.createDataFrame([(list("abcdefg"), list("bcdefgh")), ([], [])], "a array<string>, b array<string>")
    rows = df.select(similarity.jaccard(similarity.shingles(F.col("a")), similarity.shingles(F.col("b"))).alias("j")).collect()
    assert [r.j for r in rows] == [0.5, 1.0]


def test_sequence_ratio(spark):
    r = spark.createDataFrame([("abcd xyz", "bcde xyz"), (None, "")], "a string, b string").select(similarity.sequence_ratio("a", "b").alias("r")).collect()
    assert r[0].r == SequenceMatcher(None, "abcd xyz", "bcde xyz", autojunk=False).ratio() and r[1].r == 1.0


def test_first_match_order(spark):
    df = spark.range(4)
    c = rules.first_match([(F.col("id") > 2, "c"), (F.col("id") > 1, "b")], "a")
    assert [r.c for r in df.select(c.alias("c")).collect()] == ["a", "a", "b", "c"]
    with pytest.raises(Exception, match="no basis"):
        df.select(rules.or_raise([(F.col("id") > 2, "c")], "no basis")).collect()


def test_cosine_pairs_equal_brute_force(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 7}" for j in range(1, 9))) for k in range(12)], "id long, text string")
    w = features.tfidf(features.terms(docs, "id", "text"), 12, min_df=1, max_df=1.0, features=None)
    rows = {}
    for r in w.collect():
        rows.setdefault(r.id, {})[r.term] = r.w
    want = {(a, b) for a in rows for b in rows if a < b and sum(x * rows[b].get(t, 0) for t, x in rows[a].items()) >= 0.8}
    assert {(r.a, r.b) for r in dedup.cosine_pairs(w, 0.8).collect()} == want


def test_integrity(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    for f in (lambda: integrity.assert_unique(df, "k"), lambda: integrity.assert_counts(df, {"a": (F.col("v") == "a", 2)}), lambda: integrity.assert_no_columns(df, ["v"]), lambda: integrity.assert_same_rows(df, df.limit(1)), lambda: integrity.assert_apart(df, df, "k")):
        with pytest.raises(integrity.IntegrityError):
            f()
    integrity.assert_same_rows(df, df)
    (tmp_path / "a.txt").write_text("x")
    found = integrity.hash_manifest(spark, str(tmp_path))
    want = spark.createDataFrame([("a.txt", "0" * 64), ("b.txt", "1" * 64)], "file string, sha256 string")
    assert {(r.file, r.state) for r in integrity.verify_manifest(found, want).collect()} == {("a.txt", "mismatch"), ("b.txt", "missing")}
    with pytest.raises(Exception, match="no row for"):
        integrity.mandatory(df, spark.createDataFrame([(2,)], "k int"), "k").collect()


def test_latest_decision(spark):
    log = spark.createDataFrame([(1, 1, "in"), (1, 2, "out"), (2, 1, "in")], "id int, batch int, decision string")
    assert {(r.id, r.decision) for r in integrity.latest_decisions(log, "id", "batch").collect()} == {(1, "out"), (2, "in")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"x, ""y""\nz"\n2,\n', encoding="utf-8")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", 'x, "y"\nz'), ("2", None)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "d1.txt").write_text("hello")
    led = spark.createDataFrame([("d1",), ("d2",)], "rid string")
    assert {(r.rid, r.text) for r in readers.with_texts(led, readers.read_texts(spark, str(tmp_path / "t")), "rid").collect()} == {("d1", "hello"), ("d2", "")}
    with zipfile.ZipFile(tmp_path / "t" / "w.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    got = {r.kind: r.text for r in readers.extract_texts(readers.read_folder(spark, str(tmp_path / "t"))).collect()}
    assert got == {"txt": "hello", "docx": "one\ntwo"}
    df = spark.createDataFrame([(1, 0.5)], "n int, x double")
    assert writers.json_summary(df) == '{\n  "n": 1,\n  "x": 0.5\n}'
    assert writers.markdown_table(df).splitlines()[-1] == "| 1 | 0.5000 |"
    writers.zip_bundle([tmp_path / "a.csv"], tmp_path / "z.zip")
    assert zipfile.ZipFile(tmp_path / "z.zip").namelist() == ["a.csv"]


def test_pages():
    page = '<html><script type="application/ld+json">{"x": [{"articleBody": "long body here"}]}</script><body><nav><p>no</p></nav><article><p>One <b>two</b></p><p>three</p></article></body></html>'
    assert readers.article_body(page) == "long body here"
    assert readers.main_text(page) == "One two\nthree"
    assert readers.main_text("") == "" and readers.article_body(None) == ""


def test_crawl_and_fetch_status(spark, tmp_path):
    pages = spark.createDataFrame([("root", "<sitemapindex><loc>s1</loc><loc>s2</loc></sitemapindex>"), ("s1", "<urlset><loc>a</loc><loc> b </loc></urlset>"), ("s2", "<urlset><loc>a</loc></urlset>")], "url string, xml string")
    assert {r.url for r in frontier.crawl(spark.createDataFrame([("root",)], "url string"), pages, f"file://{tmp_path}")[0].collect()} == {"a", "b"}
    log = spark.createDataFrame([("u", 1, 500, 0), ("u", 2, 200, 9), ("v", 1, 404, 0), ("w", 1, 500, 0), ("w", 2, 503, 0)], "url string, attempt int, http_status int, bytes int")
    assert {(r.url, r.attempt, r.status) for r in readers.fetch_status(log).collect()} == {("u", 2, "fetched"), ("v", 1, "refused"), ("w", 2, "failed")}


def test_voice_scores(spark):
    df = spark.createDataFrame([(1, "Police report", "The police minister said nothing of note here. The company was silent about it all.")], "id int, title string, text string")
    rows = {r.group: r.score for r in stance.voice_scores(df, "id", F.col("title"), F.col("text"), {"government": [r"\bpolice\b", r"\bminister\b"], "investor": [r"\bcompany\b"]}, r"\bsaid\b").collect()}
    assert rows["government"] == pytest.approx(3.0 + 2 * 2.5) and rows["investor"] == pytest.approx(0.35)


def test_entry_works_without_llm(tmp_path):
    """The rest imports where the subpackage and the pipeline are missing."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "veldspar", tmp_path / "veldspar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert out.stdout.split()[-1] == "False", out.stderr


def test_settled_voices_and_decisions(spark):
    """Authors that are no news publishers, silence with and without an author, and margins."""
    top = spark.createDataFrame([(1, "labour", 0.0, 0.0), (2, "labour", 0.0, 0.0), (3, "labour", 5.0, 0.9), (4, "labour", 5.0, 0.9), (5, "NGO", 5.0, 0.1), (6, "NGO", 0.0, 0.0)], "id long, group string, top double, margin double")
    authors = spark.createDataFrame([(1, None, False), (2, "investor", True), (3, "investor", False), (4, "investor", True), (5, None, None)], "id long, author_group string, is_news boolean")
    got = {r.id: (r.group, r.confidence, r.method) for r in stance.settled_voice(top, authors, "id").collect()}
    assert got == {
        1: ("government", 0.0, "fallback_no_actor_signal"), 2: ("investor", 0.0, "fallback_no_actor_signal"), 3: ("investor", 1.0, "document_author_group"), 4: ("labour", 0.9, "dominant_voice_proxy"),
        5: ("NGO", 0.1, "dominant_voice_proxy"), 6: ("government", 0.0, "fallback_no_actor_signal"),
    }
    cases = [(1.0, 1.0, 1, 1, 0.5, "dominant_voice_proxy"), (1.0, 1.0, 1, 1, 0.05, "dominant_voice_proxy"), (1.0, 1.0, 1, 1, 0.0, "fallback_no_actor_signal"), (0.1, 0.1, 1, 1, 0.05, "dominant_voice_proxy"), (1.0, -1.0, 1, 0, 0.9, "dominant_voice_proxy")]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a double, b double, la int, lb int, c double, m string")
    d = stance.coding_decision(*(F.col(c) for c in ("a", "b", "la", "lb", "c", "m")))
    assert [(r.d.label, r.d.needs_review, r.d.reason) for r in df.select("k", d.alias("d")).orderBy("k").collect()] == [
        (1, False, "computational_readings_agree"), (1, True, "stakeholder_voice_low_confidence"), (1, False, "computational_readings_agree"), (None, True, "stance_readings_disagree_or_low_margin"), (None, True, "stance_readings_disagree_or_low_margin"),
    ]


def test_rules_of_records(spark):
    rows = [("Include", None), (" included ", "x"), (None, "Eligible later"), ("no", "candidate_pending_substantive_screen"), ("no", "rejected"), (None, None), ("", " VERIFIED ")]
    got = [r.e for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, d string, s string").select("k", rules.eligible(F.col("d"), F.col("s")).alias("e")).orderBy("k").collect()]
    assert got == [True, True, True, True, False, False, True]
    texts = [(None, 0, 1), ("", 0, 9), ("a", 1, 2), ("a", 149, 1), ("a", 150, 1)]
    got = [r.q for r in spark.createDataFrame([(k, *r) for k, r in enumerate(texts)], "k int, t string, w int, n int").select("k", rules.text_quality(F.col("t"), F.col("w"), F.col("n")).alias("q")).orderBy("k").collect()]
    assert got == ["missing_text", "missing_text", "repeated_extraction_hash", "short_text_review", "usable_text"]
    pairs = spark.createDataFrame([(1, True, 0.1, False), (2, None, 0.95, False), (3, False, None, True), (4, False, 0.94, None)], "k int, h boolean, r double, t boolean")
    basis = rules.duplicate_basis(F.col("h"), F.col("r"), F.col("t")).alias("b")
    assert [r.b for r in pairs.where("k < 4").select("k", basis).orderBy("k").collect()] == ["identical_text_hash", "near_identical_text", "identical_title_and_language"]
    with pytest.raises(Exception, match="a pair without a basis"):
        pairs.select(basis).collect()


def test_earlier_and_later_of_two(spark):
    rows = [("a", 2, "2020"), ("a", 1, "2021"), ("b", 1, "2020"), ("b", 2, "2020"), ("c", 1, "2020"), ("d", 1, "x"), ("d", 2, "x"), ("d", 3, "x"), (None, 1, "x"), (None, 2, "x"), ("e", 2, "2020"), ("e", 1, None)]
    got = dedup.earlier_and_later(spark.createDataFrame(rows, "k string, id long, day string"), "k", "id", "day").collect()
    assert {(r.k, r.keep, r["drop"]) for r in got} == {("a", 2, 1), ("b", 1, 2), ("e", 1, 2)}


def test_overlap_of_arrays(spark):
    df = spark.createDataFrame([(0, ["a", "b", "b"], ["b", "c"]), (1, [], ["x"]), (2, None, ["x"])], "k int, a array<string>, b array<string>")
    got = [r.o for r in df.select("k", similarity.overlap(F.col("a"), F.col("b")).alias("o")).orderBy("k").collect()]
    assert [(o.shared, o.only_a, o.only_b, o.any) for o in got] == [(["b"], ["a"], ["c"], True), ([], [], ["x"], False), (None, None, None, False)]
