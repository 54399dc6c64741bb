"""Connectors on files and a local server, sitemaps, folded titles, and group decisions on small tables."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from veldspar.functions import text
from veldspar.operators import dedup
from veldspar.sources import connectors, readers


@pytest.fixture
def server():
    """Pages /p0 .. /p39, each with the next one; /loop leads to itself; /flaky answers at the second attempt; all else is not found."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            name = self.path[1:]
            if name.startswith("p") and name[1:].isdigit() and int(name[1:]) < 40:
                k = int(name[1:])
                after = f'<a href="/p{k + 1}" rel="nofollow next">on</a>' if k % 2 else f'<a name="x">next</a><a href="/p{k + 1}">Older <b>posts</b></a>'
                body = f'<a href="/a{k}#top">item</a><a href="/nextdoor">nextdoor</a>{after}'
            elif name == "loop":
                body = '<a rel="next" href="/loop">x</a>'
            elif name == "flaky" and asked.count(self.path) > 1:
                body = '{"b": [1, "é"]}'
            else:
                self.send_error(500 if name == "flaky" else 404)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", asked
    s.shutdown()


def test_downloads(spark, tmp_path, server):
    base, asked = server
    (tmp_path / "src").write_bytes(b"x" * 20_000)
    out = tmp_path / "out"
    out.mkdir()
    (out / "had").write_text("old")
    rows = [(f"file://{tmp_path}/src", "a"), (f"{base}/p0", "had"), (f"{base}/gone", "b"), (f"file://{tmp_path}/none", "c"), (None, "d"), (f"{base}/p1", None), ("nonsense", "e")]
    urls = spark.createDataFrame(rows, "url string, file string").repartition(2)
    got = {(r.url, r.file): (r.status, r.bytes) for r in connectors.download(urls, f"file://{out}", pause=0.01).collect()}
    assert [got[r] for r in rows] == [("fetched", 20_000), ("there", 3), ("refused", None), ("failed", None), ("failed", None), ("failed", None), ("failed", None)]
    assert sorted(p.name for p in out.iterdir()) == ["a", "had"] and (out / "a").stat().st_size == 20_000 and (out / "had").read_text() == "old"
    assert asked.count("/gone") == 1 and "/p0" not in asked
    assert connectors.download(urls.where("file = 'had'"), f"file://{out}", again=True).first().status == "fetched" and "item" in (out / "had").read_text()
    assert connectors.download(urls.limit(0), f"file://{out}").count() == 0


def test_json_endpoints(spark, tmp_path, server):
    base, asked = server
    urls = spark.createDataFrame([(f"{base}/flaky", "j"), (f"{base}/p0", "k")], "url string, file string").coalesce(1)
    got = {r.file: r for r in connectors.fetch_json(urls, f"file://{tmp_path}/j", pause=0.01).collect()}
    assert (got["j"].status, got["k"].status) == ("fetched", "failed") and asked.count("/flaky") == 2
    assert json.loads((tmp_path / "j/j").read_text()) == {"b": [1, "é"]} and "\n    " in (tmp_path / "j/j").read_text()
    assert [p.name for p in (tmp_path / "j").iterdir()] == ["j"]


def test_search_pages(spark, server):
    base, _ = server
    seeds = spark.createDataFrame([(f"{base}/p0",), (f"{base}/p38",), (f"{base}/loop",), (None,)], "url string")
    got = sorted(connectors.search_pages(seeds).collect(), key=lambda r: (r.seed, r.page))
    by = {s: [r for r in got if r.seed == f"{base}/{s}"] for s in ("p0", "p38", "loop")}
    assert [r.url for r in by["p0"]] == [f"{base}/p{k}" for k in range(30)]
    assert [(r.url, r.http_status) for r in by["p38"]] == [(f"{base}/p38", 200), (f"{base}/p39", 200), (f"{base}/p40", 404)] and by["p38"][2].links is None
    assert len(by["loop"]) == 1 and len(got) == 34
    assert by["p0"][3].links == [f"{base}/a3#top", f"{base}/nextdoor", f"{base}/p4"]


def test_sitemap_locations(spark):
    index = '<?xml version="1.0"?>\n<!-- <loc>no</loc> --><!DOCTYPE x><s:sitemapindex xmlns:s="u"><s:sitemap><s:loc>\n http://h/?a=1&amp;b=&lt;2 </s:loc></s:sitemap></s:sitemapindex>'
    urls = "<urlset><url><loc><![CDATA[ http://h/?a=1&amp;b ]]></loc><locale>x</locale></url><url><loc></loc></url><url><loc>http://h/&amp;lt;</loc></url></urlset>"
    df = spark.createDataFrame([(0, index), (1, urls), (2, "none"), (3, None)], "i int, x string")
    got = {r.i: r.s for r in df.select("i", readers.sitemap_locations(F.col("x")).alias("s")).collect()}
    assert (got[0].is_index, got[0].locations, got[0].root) == (True, ["http://h/?a=1&b=<2"], "sitemapindex")
    assert (got[1].is_index, got[1].locations, got[1].root) == (False, ["http://h/?a=1&amp;b", "http://h/&lt;"], "urlset")
    assert (got[2].is_index, got[2].locations, got[2].root) == (False, [], "") and got[3].locations is None


def test_folded_titles(spark):
    titles = ["Große Maße – “fſx”", "STRAẞE", "ﬁre o’clock", "plain A-1", "", None, "Kelvin"]
    got = [r.k for r in spark.createDataFrame([(t,) for t in titles], "t string").select(text.title_key_folded(F.col("t")).alias("k")).collect()]
    want = [None if t is None else " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.casefold()).split()) for t in titles]
    assert got == want


def test_canonical_is_one_row_a_key(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", None, "z"), (None, 5, "n"), (None, 4, "m"), ("b", 1, None), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, i int, t string")
    assert {tuple(r) for r in dedup.canonical(df, "k", "i").collect()} == {("a", None, "z"), (None, 4, "m"), ("b", 1, None)}
    assert {tuple(r) for r in dedup.canonical(df, "k", F.when(F.col("t") == "x", 0).otherwise(1), "i").collect()} == {("a", 2, "x"), (None, 4, "m"), ("b", 1, None)}


def test_title_collisions(spark):
    rows = [("far", 1, "abcdef"), ("far", 2, "abcdef"), ("far", 3, "uvwxyz"), ("two", 1, "abcdef"), ("two", 2, "uvwxyz"), ("near", 1, "abcdefgh"), ("near", 2, "abcdefgi"), ("near", 3, "abcdefgj")]
    # both like the first title, not like each other
    rows += [("apart", 1, "aaaaaaabb"), ("apart", 2, "caaaaaabb"), ("apart", 3, "aaaaaaacc"), (None, 1, "a"), (None, 2, "b"), (None, 3, "c"), ("null", 1, None), ("null", 2, None), ("null", 3, "t")]
    got = dedup.title_collisions(spark.createDataFrame(rows, "h string, i int, t string"), "h", "i", "t").collect()
    assert {tuple(r) for r in got} == {("far", 3, 2), ("apart", 3, 3)}
    assert dedup.title_collisions(spark.createDataFrame([], "h string, i int, t string"), "h", "i", "t").count() == 0
