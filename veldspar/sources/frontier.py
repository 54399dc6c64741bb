"""A frontier of addresses by host as a data source, and crawls of sitemap trees on it.

The frontier is a folder: addresses in files by host, bodies and outcomes in one file an address.  ``spark.read.format("host_fetch")`` has an input partition a host, so a host is
asked by one task, at a stated rate, whatever the number of hosts.  An outcome's file is moved into place after its body's; an address that has one isn't asked again, so a task that is killed and
runs again, or a crawl that is started anew, goes on where it ended.
"""

from __future__ import annotations

import hashlib
import http.client
import http.cookiejar
import json
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.order import numbered
from ..session import ship
from ..tables import written
from .readers import sitemap_locations

SCHEMA = "url string, host string, final_url string, http_status int, status string, bytes long, content_type string, file string, attempts int, error string"
#: Answers after which no further attempt is made.
FINAL = (401, 403, 404, 410)
_FIELDS = [x.split(" ")[0] for x in SCHEMA.split(", ")]


class Host:
    """Requests to one host, ``interval`` seconds apart or more, with its cookies."""

    def __init__(self, interval: float, timeout: float, headers: dict[str, str]):
        self.interval, self.timeout, self.headers, self.last = interval, timeout, headers, -1e9
        self.opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(http.cookiejar.CookieJar()))

    def ask(self, url: str, use: Callable, more: dict[str, str] | None = None) -> tuple:
        """(HTTP status or none, address after redirects, type, what ``use`` makes of a 200's body, error)."""
        time.sleep(max(0.0, self.last + self.interval - time.monotonic()))
        try:
            with self.opener.open(urllib.request.Request(url, headers=self.headers | (more or {})), timeout=self.timeout) as r:
                code = r.status or 200
                return code, r.geturl(), r.headers.get("Content-Type", ""), use(r) if code == 200 else None, "" if code == 200 else f"HTTP {code}"
        except urllib.error.HTTPError as e:
            return e.code, e.geturl(), e.headers.get("Content-Type", ""), None, f"HTTP {e.code}"
        except (OSError, ValueError, http.client.HTTPException) as e:
            return None, url, "", None, f"{type(e).__name__}: {e}"
        finally:
            self.last = time.monotonic()


def rule_for(url: str, rules: list[dict]) -> tuple[dict, str] | None:
    """The first warm-up rule whose ``match`` finds something in an address, and the address to visit before: ``parent`` with the match's groups."""
    for rule in rules:
        if m := re.search(rule["match"], url):
            return rule, m.expand(rule["parent"])
    return None


def is_asset(rule: dict, head: bytes, kind: str, size: int) -> bool:
    """Whether an answer looks like what a rule is for, and not like a stub: it begins with ``magic``, or its type has ``type`` and it is longer than ``least`` bytes."""
    return head.startswith(rule["magic"].encode()) or (rule["type"] in kind.lower() and size > rule["least"])


class HostReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.interval, self.timeout, self.attempts, self.pause = (float(options.get(k, d)) for k, d in (("interval", 1), ("timeout", 30), ("attempts", 2), ("pause", 2)))
        self.rules, self.headers = json.loads(options.get("warmups", "[]")), json.loads(options.get("headers", "{}"))

    def partitions(self) -> list[InputPartition]:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        found = fs.get_file_info(pafs.FileSelector(f"{base}/urls", allow_not_found=True))
        return [InputPartition(x.base_name) for x in sorted(found, key=lambda x: x.base_name) if x.type == pafs.FileType.Directory]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(f"{base}/bodies", recursive=True)
        host, seen = Host(self.interval, self.timeout, self.headers), set()
        for batch in pads.dataset(f"{base}/urls/{partition.value}", filesystem=fs, format="parquet").to_batches(columns=["url"]):
            rows = []
            for url in batch.column(0).to_pylist():
                if url not in seen:
                    seen.add(url)
                    rows.append(self.outcome(fs, f"{base}/bodies", host, url))
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def outcome(self, fs, folder: str, host: Host, url: str) -> dict:
        name = hashlib.sha256(url.encode()).hexdigest()
        note = f"{folder}/{name}.json"
        if fs.get_file_info(note).type == pafs.FileType.File:
            with fs.open_input_stream(note) as f:
                return json.loads(f.read())
        got = self.fetch(fs, folder, host, url, name)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(got).encode())
        fs.move(draft, note)
        return got

    def fetch(self, fs, folder: str, host: Host, url: str, name: str) -> dict:
        draft = f"{folder}/.{uuid.uuid4().hex}"

        def use(response) -> tuple[int, bytes]:
            size, head = 0, b""
            with fs.open_output_stream(draft) as out:
                while part := response.read(1 << 16):
                    head = (head + part)[:8] if len(head) < 8 else head
                    size += out.write(part)
            return size, head

        tries, code, at, kind, body, error, why = 0, None, url, "", None, "", ""
        if found := rule_for(url, self.rules):
            rule, parent = found
            host.ask(parent, lambda r: r.read())
            tries += 1
            code, at, kind, body, error = host.ask(url, use, {"Referer": parent} | rule.get("headers", {}))
            if body and not is_asset(rule, body[1], kind, body[0]):
                body, why = None, f"stub of {body[0]} bytes"
        while not body and tries < self.attempts + bool(found) and not (tries and code in FINAL):
            if tries > bool(found):
                time.sleep((tries - bool(found)) * self.pause)
            tries += 1
            code, at, kind, body, error = host.ask(url, use)
            if body and found and not is_asset(found[0], body[1], kind, body[0]):
                body, why = None, f"stub of {body[0]} bytes"
        if body:
            fs.move(draft, f"{folder}/{name}")
        elif fs.get_file_info(draft).type == pafs.FileType.File:
            fs.delete_file(draft)
        status = "fetched" if body else "stub" if code == 200 else "refused" if code in FINAL else "failed"
        values = (url, urlsplit(url).netloc.lower(), at, code, status, body[0] if body else None, kind, name if body else None, tries, None if body else why or error)
        return dict(zip(_FIELDS, values))


_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64()}.get(t, pa.string())) for n, t in (x.split(" ") for x in SCHEMA.split(", "))])


class HostFetch(DataSource):
    """Format ``host_fetch``: outcomes of the addresses of a frontier (option path).

    Options: interval (seconds between requests to a host), attempts, pause (seconds, times the attempt's number), timeout, headers and warmups (JSON).  A warm-up rule has ``match``, ``parent``, ``magic``, ``type``,
    ``least`` and perhaps ``headers``: the parent is visited first, in the same session, and 200 answers that aren't the asset are stubs.
    """

    @classmethod
    def name(cls) -> str:
        return "host_fetch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HostReader(dict(self.options))


def add_urls(urls: DataFrame, folder: str) -> None:
    """Put addresses (column url) on the frontier, a folder a host.  Null ones and those without a host are left out; repeated ones do no harm."""
    rows = urls.select("url").where("url is not null").distinct().withColumn("host", F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))).where("host <> ''")
    rows.repartition("host").write.mode("append").partitionBy("host").parquet(f"{folder}/urls")


def fetch(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Outcomes of all addresses of a frontier; those fetched before are read from their files.  Lazy: write it, and read the written table."""
    ship(spark)
    spark.dataSource.register(HostFetch)
    given = {k: json.dumps(v) if isinstance(v, (list, dict)) else str(v) for k, v in options.items()}
    return spark.read.format("host_fetch").options(**given).load(folder)


def bodies(spark: SparkSession, folder: str, outcomes: DataFrame) -> DataFrame:
    """(url, final_url, text) of fetched addresses; bodies that aren't UTF-8 have replacement characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            texts = []
            for name in batch.column(2).to_pylist():
                with fs.open_input_stream(f"{base}/bodies/{name}") as f:
                    texts.append(f.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["url", "final_url", "text"])

    return outcomes.where("status = 'fetched'").select("url", "final_url", "file").mapInArrow(run, "url string, final_url string, text string")


def network(spark: SparkSession, folder: str, **options) -> Callable[[DataFrame], DataFrame]:
    """A way for ``crawl`` to read documents: from hosts, through a frontier in ``folder``."""

    def read(urls: DataFrame) -> DataFrame:
        step = f"{folder}/step-{uuid.uuid4().hex}"
        wanted = written(urls.select("url"), step, "wanted")
        add_urls(wanted, folder)
        got = written(fetch(spark, folder, **options).join(wanted, "url", "left_semi"), step, "outcomes")
        return bodies(spark, folder, got).select("url", F.col("text").alias("xml"))

    return read


def crawl(seeds: DataFrame, read: Callable[[DataFrame], DataFrame] | DataFrame, folder: str, depth: int = 3, most: int = 500, children: int = 300, prefer: str = "post|article|news|page") -> tuple[DataFrame, DataFrame]:
    """((url, depth) of leaves, (url, depth, kind, locations) of documents read): a sitemap tree breadth first, from seeds (url, perhaps place).

    Limits are those of the feature: ``most`` documents read in the whole crawl (those that can't be read don't count), ``depth`` levels below the seeds, ``children`` of an index.  Of an index that has children that match ``prefer``, only these
    are followed.  ``read`` gives (url, xml) for a table of addresses, or is such a table.  An address is read once, at its first place.
    """
    get = read if callable(read) else lambda urls: urls.join(read, "url").select("url", "xml")
    spark, place = seeds.sparkSession, F.col("place") if "place" in seeds.columns else F.lit(0)
    level = written(numbered(seeds.where("url is not null").groupBy("url").agg(F.min(place).alias("p")), "p", "url").select("url", "k"), folder, "level0")
    seen, docs, done = None, None, 0
    for d in range(depth + 1):
        left, own = level, None
        while done < most:
            part = written(left.orderBy("k").limit(most - done), folder, f"part{d}-{done}-{uuid.uuid4().hex}")
            if part.isEmpty():
                break
            got = written(get(part.select("url")).join(part, "url").select("url", "k", sitemap_locations(F.col("xml")).alias("s")), folder, f"read{d}-{done}-{uuid.uuid4().hex}")
            seen = part.select("url") if seen is None else seen.union(part.select("url"))
            own = got if own is None else own.union(got)
            n = got.count()
            done += n
            left = left.join(part.select("url"), "url", "left_anti")
            if n == 0 and left.isEmpty():
                break
        if own is None:
            break
        own = own.select("url", "k", F.lit(d).alias("depth"), "s.*")
        docs = own if docs is None else docs.union(own)
        index = own.where("is_index")
        liked = F.filter("locations", lambda x: F.lower(x).rlike(prefer))
        index = index.select("k", F.posexplode(F.slice(F.when(F.size(liked) > 0, liked).otherwise(F.col("locations")), 1, children)).alias("at", "url"))
        first = index.groupBy("url").agg(F.min(F.struct("k", "at")).alias("p")).join(seen, "url", "left_anti")
        level = written(numbered(first.select("url", "p"), "p", "url").select("url", "k"), folder, f"level{d + 1}")
    if docs is None:
        none = spark.createDataFrame([], "url string, depth int, kind string, locations int")
        return none.select("url", "depth"), none
    docs = written(docs, folder, "documents")
    leaves = docs.where("root = 'urlset'").select(F.explode("locations").alias("url"), "depth").groupBy("url").agg(F.min("depth").alias("depth"))
    return leaves, docs.select("url", "depth", F.col("root").alias("kind"), F.size("locations").alias("locations"))
