"""Sources: Parquet tables, text and binary files, JSON lines, and web pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_documents(spark: SparkSession, path: str, parser: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, text) of every file below a folder; parser turns other formats than UTF-8 text, such as PDF, into text on the executors."""
    if parser is None:
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [parser(bytes(c)) for c in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, text string")


def json_lines(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """Append-only JSON lines, such as pending queues and audit logs, as a batch or as a stream; bad lines are kept in _corrupt_record."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).option("mode", "PERMISSIVE").json(path)


#: Elements dropped from a page, elements and markers tried for its main part, and the least text of it.
DROPPED = {"script", "style", "nav", "header", "footer", "aside"}
PREFERRED = ("article", "main", "#content", ".content", "body")
LEAST_MAIN = 200
PAGE_CAP = 8000
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    """Collects text nodes with the open elements around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, set[str]]] = []
        self.nodes: list[tuple[str, frozenset]] = []
        self.first: dict[str, int] = {}
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        a = dict(attrs)
        marks = {tag} | ({"#content"} if a.get("id") == "content" else set()) | ({".content"} if "content" in (a.get("class") or "").split() else set())
        self.count += 1
        names = set()
        for m in marks & set(PREFERRED):
            self.first.setdefault(m, self.count)
            if self.first[m] == self.count:
                names.add(m)
        self.open.append((tag, names))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if data.strip() and not any(t in DROPPED for t, _ in self.open):
            self.nodes.append((data.strip(), frozenset(n for _, names in self.open for n in names)))


def main_part(html: str | None) -> str:
    """Text of a page's main part, whole."""
    page = _Page()
    page.feed(html or "")
    page.close()
    for mark in PREFERRED:
        own = [t for t, names in page.nodes if mark in names]
        if sum(map(len, own)) > LEAST_MAIN:
            return " ".join(own)
    return " ".join(t for t, _ in page.nodes)


def page_text(html: str | None) -> str:
    """The beginning of main_part(), at most PAGE_CAP characters, as a model's prompt takes it; no query uses it."""
    return main_part(html)[:PAGE_CAP]


def web_pages(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each, whole."""

    @F.arrow_udf("string")
    def extract(html: pa.Array) -> pa.Array:
        return pa.array((main_part(x.as_py()) for x in html), pa.string())  # one page at a time, not a batch of strings

    return pages.withColumn(out, extract(html_col))


def specialties(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Dimension of specialty plugins from their YAML texts: (specialty, stub, keywords)."""
    rows = []
    for t in texts:
        name = re.search(r"^specialty:\s*(\S+)", t, re.M)
        words = re.search(r"^keywords:\n((?:\s+-\s.*\n?)+)", t, re.M)
        if name:
            rows.append((name[1], bool(re.search(r"^status:\s*stub", t, re.M)), re.findall(r"-\s+(.+?)\s*$", words[1], re.M) if words else []))
    return spark.createDataFrame(rows, "specialty string, stub boolean, keywords array<string>")
