"""Frontiers and crawls on a local server."""

import http.server
import json
import re
import threading
import time
from collections import deque

import pytest

from veldspar.sources import frontier, readers


@pytest.fixture
def server():
    """Pages by path: /r redirects, /gone is 404, /flaky answers at the second attempt, assets are stubs without a cookie and a referrer, /tree is a sitemap."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((time.monotonic(), self.path))
            own = [p for _, p in asked].count(self.path)
            code, body, kind, more = 200, f"page {self.path}", "text/html", {}
            if self.path == "/r":
                code, more = 302, {"Location": "/to"}
            elif self.path == "/gone":
                code = 404
            elif self.path == "/down" or (self.path == "/flaky" and own == 1):
                code = 503
            elif self.path == "/2013/":
                more = {"Set-Cookie": "seen=1"}
            elif self.path.endswith(".pdf"):
                ok = "seen=1" in self.headers.get("Cookie", "") and self.headers.get("Referer", "").endswith("/2013/") and "stub" not in self.path
                body, kind = ("%PDF-1.4 " + "x" * 2000, "application/pdf") if ok else ("<html>no hot links</html>", "text/html")
            elif self.path in TREE:
                body, kind = TREE[self.path].replace("@", f"http://{self.headers['Host']}"), "text/xml"
            self.send_response(code)
            for k, v in ({"Content-Type": kind} | more).items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}", asked
    s.shutdown()


def sitemap(kind, names):
    return f"<{kind}>" + "".join(f"<x><loc>@/{n}</loc></x>" for n in names) + f"</{kind}>"


TREE = {
    "/tree": sitemap("sitemapindex", ["images.xml", "posts-1.xml", "news.xml", "gone", "tree"]), "/posts-1.xml": sitemap("urlset", ["a", "b"]), "/news.xml": sitemap("sitemapindex", ["plain.xml", "deep.xml"]), "/images.xml": sitemap("urlset", ["picture"]),
    "/plain.xml": sitemap("urlset", ["b", "c"]), "/deep.xml": sitemap("sitemapindex", ["deeper.xml"]), "/deeper.xml": sitemap("urlset", ["d"]),
}
RULES = [{"match": r"^(https?://[^/]+)/(20\d\d)/down", "parent": r"\1/\2/", "magic": "%PDF", "type": "application/pdf", "least": 1024}]


def test_outcomes_redirects_and_stubs(spark, tmp_path, server):
    base, asked = server
    names = ["/a", "/r", "/gone", "/flaky", "/down", "/2013/downloads/good.pdf", "/2013/downloads/stub.pdf"]
    urls = spark.createDataFrame([(base + n,) for n in names] + [(base + "/a",), (None,), ("no address",), ("http://127.0.0.1:9/x",)], "url string")
    folder = f"file://{tmp_path}/frontier"
    frontier.add_urls(urls, folder)
    options = {"interval": 0.05, "pause": 0.01, "timeout": 5, "warmups": RULES}
    got = {r.url.removeprefix(base): r for r in frontier.fetch(spark, folder, **options).collect()}
    assert {k: r.status for k, r in got.items()} == dict(zip(names, ["fetched", "fetched", "refused", "fetched", "failed", "fetched", "stub"])) | {"http://127.0.0.1:9/x": "failed"}
    assert got["/r"].final_url == base + "/to" and got["/flaky"].attempts == 2 and got["/gone"].attempts == 1 and got["/2013/downloads/good.pdf"].bytes == 2009 and got["/2013/downloads/stub.pdf"].error.startswith("stub")
    times = [t for t, _ in asked]
    assert min(b - a for a, b in zip(times, times[1:]) if a != b) > 0 and times[-1] - times[0] > 0.05 * 8, "a request each interval"
    before = len(asked)
    again = {r.url.removeprefix(base): r.status for r in frontier.fetch(spark, folder, **options).collect()}
    assert again == {k: r.status for k, r in got.items()} and len(asked) == before, "nothing is asked again"
    assert {r.url.removeprefix(base): r.text for r in frontier.bodies(spark, folder, frontier.fetch(spark, folder, **options)).collect()}["/r"] == "page /to"


def test_a_killed_task_goes_on(spark, tmp_path, server):
    base, asked = server
    folder = f"file://{tmp_path}/frontier"
    frontier.add_urls(spark.createDataFrame([(f"{base}/p{k}",) for k in range(20)], "url string").coalesce(1), folder)
    reader = frontier.HostReader({"path": folder, "interval": "0", "pause": "0"})
    (partition,) = reader.partitions()
    done = []

    class Killed(Exception):
        pass

    def stop(*a, old=reader.fetch):
        if len(done) == 7:
            raise Killed
        done.append(a[3])
        return old(*a)

    reader.fetch = stop
    with pytest.raises(Killed):
        list(reader.read(partition))
    assert len(asked) == 7
    got = frontier.fetch(spark, folder, interval=0, pause=0).collect()
    assert len(got) == 20 and {r.status for r in got} == {"fetched"} and sorted(p for _, p in asked) == sorted(f"/p{k}" for k in range(20)), "each address once"


def plain_crawl(tree, seeds, depth=3, most=500, children=300):
    """A queue, an address at a time."""
    queue, seen, read, leaves = deque((s, 0) for s in seeds), set(), [], {}
    while queue and len(read) < most:
        url, d = queue.popleft()
        if url in seen or d > depth:
            continue
        seen.add(url)
        if url not in tree:
            continue
        read.append(url)
        locations = re.findall("<loc>(.*?)</loc>", tree[url])
        if "sitemapindex" in tree[url]:
            liked = [x for x in locations if re.search("post|article|news|page", x.lower())]
            queue.extend((x, d + 1) for x in (liked or locations)[:children] if x not in seen)
        else:
            for x in locations:
                leaves[x] = min(d, leaves.get(x, d))
    return read, leaves


@pytest.mark.parametrize("limits", [{}, {"most": 4}, {"depth": 1}, {"children": 1}, {"most": 1}])
def test_crawl_limits_equal_a_queue(spark, tmp_path, limits):
    tree = {f"@{k}": v for k, v in TREE.items()}
    # a wide index, one that can't be read, an index that two lead to
    tree["@/wide"] = sitemap("sitemapindex", [f"leaf{k}" for k in range(9)] + ["missing", "news.xml"])
    tree |= {f"@/leaf{k}": sitemap("urlset", [f"x{k}", "shared"]) for k in range(9)}
    table = spark.createDataFrame(list(tree.items()), "url string, xml string")
    seeds = ["@/nothing", "@/wide", "@/tree"]
    leaves, docs = frontier.crawl(spark.createDataFrame([(s, k) for k, s in enumerate(seeds)], "url string, place int"), table, f"file://{tmp_path}", **limits)
    read, want = plain_crawl(tree, seeds, **limits)
    assert {r.url for r in docs.collect()} == set(read) and docs.count() == len(read) and {r.url: r.depth for r in leaves.collect()} == want


def test_crawl_over_the_network(spark, tmp_path, server):
    base, asked = server
    seeds = spark.createDataFrame([(f"{base}/tree",)], "url string")
    read = frontier.network(spark, f"file://{tmp_path}/frontier", interval=0, pause=0)
    leaves, docs = frontier.crawl(seeds, read, f"file://{tmp_path}/crawl")
    assert {r.url.removeprefix(base): r.depth for r in leaves.collect()} == {"/a": 1, "/b": 1, "/c": 2, "/d": 3} and json.loads(json.dumps(sorted(r.kind for r in docs.collect()))).count("urlset") == 3
    before = len(asked)
    again, _ = frontier.crawl(seeds, read, f"file://{tmp_path}/again")
    assert again.count() == 4 and len(asked) == before, "a crawl that is started anew asks nothing again"
    assert frontier.crawl(seeds.limit(0), read, f"file://{tmp_path}/none")[0].count() == 0 and readers is not None
