"""Downloads, JSON endpoints and paged searches, fetched by tasks.

Addresses are rows of a table.  A task fetches its own, one after the other; a file is written under another name and then moved, so that a task that
runs again, or twice at once, leaves one whole file.  The tables returned are lazy: write them, and read the written ones.
"""

from __future__ import annotations

import http.client
import json
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import Page

#: Answers after which no further attempt is made.
FINAL = (401, 403, 404, 410)
CHUNK = 1 << 13
OUTCOME = "url string, file string, status string, http_status int, bytes long, error string"
VISITS = "seed string, page int, url string, http_status int, bytes long, links array<string>, error string"


def attempt(url: str, use: Callable, attempts: int = 3, pause: float = 2.0, timeout: float = 60.0) -> tuple[int | None, object, str]:
    """(HTTP status, what ``use`` makes of the open response, error): up to ``attempts`` times, with a pause that grows by each; final answers end it."""
    code, error = None, ""
    for k in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as response:
                code = response.status or 200  # files have none
                if code == 200:
                    return code, use(response), ""
                error = f"HTTP {code}"
        except urllib.error.HTTPError as e:
            code, error = e.code, f"HTTP {e.code}"
        except (OSError, ValueError, http.client.HTTPException) as e:  # no connection, no such file, an address or an answer without sense
            code, error = None, f"{type(e).__name__}: {e}"
        if code in FINAL:
            break
        if k < attempts:
            time.sleep(k * pause)
    return code, None, error


def _stream(out) -> Callable:
    def use(response) -> int:
        n = 0
        while part := response.read(CHUNK):
            n += out.write(part)
        return n

    return use


def _pretty(out) -> Callable:
    return lambda response: out.write(json.dumps(json.loads(response.read()), indent=4, ensure_ascii=False).encode())


def _files(folder: str, again: bool, pretty: bool, attempts: int, pause: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)

        def one(url: str | None, file: str | None) -> tuple:
            if not url or not file:
                return url, file, "failed", None, None, "no address or file name"
            final, draft = f"{base}/{file}", f"{base}/.{uuid.uuid4().hex}"
            had = fs.get_file_info(final)
            if had.type == pafs.FileType.File and not again:
                return url, file, "there", None, had.size, None

            def use(response) -> int:
                with fs.open_output_stream(draft) as out:  # anew for each attempt
                    return (_pretty if pretty else _stream)(out)(response)

            code, size, error = attempt(url, use, attempts, pause)
            if size is None:
                if fs.get_file_info(draft).type == pafs.FileType.File:
                    fs.delete_file(draft)
                return url, file, "refused" if code in FINAL else "failed", code, None, error
            fs.move(draft, final)
            return url, file, "fetched", code, size, None

        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string())
        for batch in batches:
            rows = [one(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            cols = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["url", "file", "status", "http_status", "bytes", "error"])

    return run


def download(urls: DataFrame, folder: str, again: bool = False, attempts: int = 3, pause: float = 2.0) -> DataFrame:
    """Files of a table (url, file) in ``folder`` (a URI), and the outcome of each: ``there`` (not fetched again unless ``again``), ``fetched``,
    ``refused`` (401, 403, 404, 410) or ``failed``.  Bodies are streamed.  Rows without address or name fail; of rows with one file name any may be the last.
    """
    return urls.select("url", "file").mapInArrow(_files(folder, again, False, attempts, pause), OUTCOME)


def fetch_json(urls: DataFrame, folder: str, again: bool = True, attempts: int = 3, pause: float = 2.0) -> DataFrame:
    """Answers of JSON endpoints (url, file) as indented JSON files in ``folder``; outcomes as of ``download``.  What isn't JSON fails."""
    return urls.select("url", "file").mapInArrow(_files(folder, again, True, attempts, pause), OUTCOME)


def next_page(page: Page) -> str | None:
    """The address of a page's ``rel=next`` anchor, or else of the first anchor whose text begins with next, older or more."""
    for rel, _, href in page.anchors:
        if href and "next" in rel.lower().split():
            return href
    return next((href for _, label, href in page.anchors if href and re.match(r"(?:next|older|more)\b", label.strip(), re.I)), None)


def _follow(most: int, attempts: int, pause: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string())
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                url, seen, rows = seed, set(), []
                while url and url not in seen and len(seen) < most:
                    seen.add(url)
                    code, got, error = attempt(url, lambda r: (r.geturl(), r.read()), attempts, pause)
                    if got is None:
                        rows.append((seed, len(seen), url, code, None, None, error))
                        break
                    at, body = got
                    page = Page()
                    page.feed(body.decode("utf-8", "replace"))
                    rows.append((seed, len(seen), url, code, len(body), [urljoin(at, x) for x in page.links], None))
                    url = (to := next_page(page)) and urljoin(at, to)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["seed", "page", "url", "http_status", "bytes", "links", "error"])

    return run


def search_pages(seeds: DataFrame, most: int = 30, attempts: int = 1, pause: float = 0.2) -> DataFrame:
    """Pages of each seed address (column url) and their links: from page to next page, ``most`` at most, until there is no next, one was seen before or a fetch fails.

    The bound is a feature: a search may have pages without end.  A seed's pages follow each other in one task; seeds are apart.  Null seeds give no row.
    """
    return seeds.select(F.col("url")).mapInArrow(_follow(most, attempts, pause), VISITS)
