"""Scans with explicit schemas, and text extraction from files and pages."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, all columns strings, blanks null; quotes and line breaks inside fields are kept."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns]) if columns else None
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = r.schema(schema).csv(path) if schema else r.csv(path)
    return df.select(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns))


def read_candidates(spark: SparkSession, shapes: list[tuple[str, list[str]]]) -> DataFrame:
    """Candidate files of several shapes as one table, with the file's name; status and reason come from whichever column has them."""
    out = None
    for path, columns in shapes:
        df = read_csv(spark, path, columns).withColumn("file", F.lit(path.rsplit("/", 1)[-1]))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    for name, others in (("status", ("screening_status", "status")), ("reason", ("decision_reason", "relevance_note"))):
        have = [F.col(c) for c in others if c in out.columns]
        out = out.withColumn(f"any_{name}", F.coalesce(*have) if have else F.lit(None).cast("string"))
    return out


def read_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file, or a glob of them, of stated types with its file's name, in the order of names; a field of another type stops the query."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").schema(schema)
    return r.csv(path).withColumn("file", F.col("_metadata.file_name")).orderBy("file")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file of one JSON value."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text) of the .txt files of a folder, the id being the file's stem."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("id"), F.col("value").alias("text"))


def with_texts(ledger: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
    """The ledger with its texts; a missing one is empty."""
    return ledger.join(texts.withColumnRenamed("id", id_col), id_col, "left").withColumn("text", F.coalesce("text", F.lit("")))


def read_folder(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("pdf", "docx", "txt", "json")) -> DataFrame:
    """(file, kind, content, bytes) of the files below a folder whose extension is one of ``kinds``; error pages under 500 bytes of JSON are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(name.alias("file"), kind.alias("kind"), "content", F.col("length").alias("bytes")).where(F.col("kind").isin(*kinds) & ~((F.col("kind") == "json") & (F.col("bytes") < 500)))


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX file, or nothing if it isn't one."""
    try:
        tree = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in tree.iter(f"{w}p")).strip()


def pdf_text(content: bytes) -> str:
    """Text of a PDF file by whichever library is there; accepted with 80 words or 500 characters."""
    for name in ("pypdf", "pdfplumber", "fitz"):
        try:
            module = __import__(name)
        except ImportError:
            continue
        try:
            if name == "pypdf":
                text = "\n".join(p.extract_text() or "" for p in module.PdfReader(io.BytesIO(content)).pages)
            elif name == "pdfplumber":
                with module.open(io.BytesIO(content)) as doc:
                    text = "\n".join(p.extract_text() or "" for p in doc.pages)
            else:
                text = "\n".join(p.get_text() for p in module.open(stream=content, filetype="pdf"))
        except Exception:  # noqa: BLE001  a broken file: the next library may read it
            continue
        if len(text.split()) >= 80 or len(text) >= 500:
            return text
    return ""


def json_text(content: bytes) -> str:
    """All values of a JSON file, one a line."""

    def walk(x: object) -> Iterator[str]:
        if isinstance(x, dict):
            for v in x.values():
                yield from walk(v)
        elif isinstance(x, list):
            for v in x:
                yield from walk(v)
        elif x is not None:
            yield str(x)

    try:
        return "\n".join(walk(json.loads(content)))
    except ValueError:
        return ""


def extract_texts(files: DataFrame) -> DataFrame:
    """(file, kind, text, words) of ``read_folder``'s rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        how = {"docx": docx_text, "pdf": pdf_text, "json": json_text, "txt": lambda b: b.decode("utf-8-sig", "replace")}
        for pdf in batches:
            texts = [how[k](bytes(b)) if k in how else "" for k, b in zip(pdf["kind"], pdf["content"])]
            yield pd.DataFrame({"file": pdf["file"], "kind": pdf["kind"], "text": texts, "words": [len(t.split()) for t in texts]})

    return files.select("file", "kind", "content").mapInPandas(run, "file string, kind string, text string, words long")


class Page(HTMLParser):
    """Text of paragraphs by container, script-like parts left out, and links."""

    SKIP = frozenset(("script", "style", "nav", "footer", "header", "form"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.parts: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.links: list[str] = []
        self.anchors: list[tuple[str, str, str]] = []  # (rel, label, address or none)
        self.json: list[str] = []
        self.loading = False

    def handle_starttag(self, tag, attrs):
        d = dict(attrs)
        if tag == "a" and d.get("href"):
            self.links.append(d["href"])
        if tag == "a":
            self.anchors.append((d.get("rel") or "", "", d.get("href") or ""))
        self.loading = tag == "script" and d.get("type") == "application/ld+json"
        if tag not in ("br", "img", "meta", "link", "hr", "input"):
            self.open.append(tag)
        if tag == "p":
            for x in self.parts.values():
                x.append("\n")

    def handle_endtag(self, tag):
        self.loading = False
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if "a" in self.open and self.anchors:
            rel, label, href = self.anchors[-1]
            self.anchors[-1] = (rel, label + data, href)
        if self.loading:
            self.json.append(data)
        elif not self.SKIP & set(self.open) and "p" in self.open:
            for k, x in self.parts.items():
                if k in self.open or k == "body":
                    x.append(data)


def article_body(html: str) -> str:
    """The longest articleBody in a page's JSON-LD, at any depth."""
    page = Page()
    page.feed(html or "")
    found = []
    for text in page.json:
        try:
            stack = [json.loads(text)]
        except ValueError:
            continue
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                if isinstance(x.get("articleBody"), str):
                    found.append(x["articleBody"])
                stack.extend(x.values())
            elif isinstance(x, list):
                stack.extend(x)
    return max(found, key=len, default="")


def main_text(html: str) -> str:
    """Paragraphs of the article, or else of the main part, or of the body."""
    page = Page()
    page.feed(html or "")
    for x in ("article", "main", "body"):
        text = re.sub(r"[ \t\r\f]+", " ", "".join(page.parts[x]))
        text = re.sub(r"\s*\n\s*", "\n", text).strip()
        if text:
            return text
    return ""


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("extractor", T.StringType()), T.StructField("text", T.StringType()), T.StructField("words", T.LongType())])))
def page_candidates(html: pd.Series) -> pd.Series:
    """What each extractor makes of a page."""
    out = []
    for h in html:
        pairs = (("json_ld", article_body(h or "")), ("paragraphs", main_text(h or "")))
        out.append([{"extractor": k, "text": t, "words": len(t.split())} for k, t in pairs])
    return pd.Series(out)


def best_candidate(candidates: Column) -> Column:
    """The candidate with the most words; ties go to the first."""
    return F.aggregate(candidates, candidates[0], lambda a, x: F.when(x["words"] > a["words"], x).otherwise(a))


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_links(html: pd.Series, base: pd.Series) -> pd.Series:
    out = []
    for h, b in zip(html, base):
        page = Page()
        page.feed(h or "")
        out.append([urljoin(b or "", x) for x in page.links])
    return pd.Series(out)


# The entities that XML itself defines; the ampersand comes last, so that no entity arises from two.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def sitemap_locations(xml: Column) -> Column:
    """(index, locations, root): whether an XML text is a sitemap of sitemaps, the addresses in it, and its root's name.

    Names may have a prefix, addresses may stand in CDATA sections, where entities are plain text; comments are left out.  Text that isn't XML has no root and
    what looks like addresses in it; null has neither.
    """
    plain = F.regexp_replace(xml, r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(plain, F.lit(r"(?s)<(?:[\w.-]+:)?loc(?:\s[^>]*)?>\s*(.*?)\s*</(?:[\w.-]+:)?loc\s*>"), F.lit(1))

    def text(x: Column) -> Column:
        out = x
        for entity, c in ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(c))
        return F.when(x.startswith("<![CDATA["), F.trim(F.regexp_extract(x, r"(?s)^<!\[CDATA\[(.*?)\]\]>$", 1))).otherwise(out)

    root = F.lower(F.regexp_extract(plain, r"(?s)<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)(?=[\s/>])", 1))
    return F.struct((root == "sitemapindex").alias("is_index"), F.filter(F.transform(found, text), lambda x: x != "").alias("locations"), root.alias("root"))


def fetch_status(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """The outcome of each URL from a log (url, attempt, http_status, bytes): the first success, or the first final refusal, or the last failure."""
    final = F.col("http_status").isin(401, 403, 404, 410)
    ok = F.col("http_status").between(200, 299)
    first = attempts.where(F.col("attempt") <= limit).groupBy("url").agg(
        F.min_by(F.struct("attempt", "http_status", "bytes"), F.struct((~(ok | final)).alias("x"), F.when(ok | final, F.col("attempt")).otherwise(-F.col("attempt")).alias("y"))).alias("r")
    )
    status = F.when(F.col("r.http_status").between(200, 299), "fetched").when(F.col("r.http_status").isin(401, 403, 404, 410), "refused").otherwise("failed")
    return first.select("url", F.col("r.attempt").alias("attempt"), F.col("r.http_status").alias("http_status"), status.alias("status"))
