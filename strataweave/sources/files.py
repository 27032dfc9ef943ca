"""Offline sources: saved pages, text, URL lists, source trees. All are Spark readers."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders and files that hold no product source.
SKIPPED_FOLDERS = ("tests", "test", "__pycache__", ".git", "venv", "env", "node_modules", "build", "dist", ".pytest_cache", "docs", "examples", "example", "demo", "benchmark")
SKIPPED_FILES = ("setup.py", "conftest.py")
LARGEST_FILE = 500_000


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """url, markdown of text or markdown files; empty ones are left out, blank ones are not."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("markdown")).filter(F.col("markdown") != "")


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, html of the .html files of a folder, not of its subfolders; bytes that aren't UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "false").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), _utf8("content").alias("html"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """url of a JSON file that is a list, or an object with a list `urls`."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.from_json("v", "urls array<string>")["urls"])
    return whole.select(F.explode(F.when(listed.isNull(), F.raise_error(F.lit("a list of URLs or an object with urls is wanted")).cast("array<string>")).otherwise(listed)).alias("url"))


def source_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".dml", ".py")) -> DataFrame:
    """path, kind, source of files of these suffixes under root; bytes that aren't UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)
    kind = F.when(F.col("path").endswith(".py"), "python").otherwise(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), kind.alias("kind"), F.col("length"), _utf8("content").alias("source"))


def _utf8(column: str):
    @F.pandas_udf("string")
    def decoded(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return decoded(F.col(column))


def empty_files(spark: SparkSession, root: str, suffix: str) -> list[str]:
    """Paths below root of files without a byte, which file scans pass over. One
    checkout's listing, made on the driver."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    base = store.makeQualified(folder).toString().rstrip("/") + "/"
    found, files = [], store.listFiles(folder, True)
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0 and f.getPath().getName().endswith(suffix):
            found.append(f.getPath().toString().removeprefix(base))
    return sorted(found)


def repository(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and source of a checkout's Python files, without tests, set-up files and large files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root).filter(F.col("length") < LARGEST_FILE)
    base = root.rstrip("/").removeprefix("file://")
    below = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(base) + 2, 1 << 20)
    blank = spark.createDataFrame([(x,) for x in empty_files(spark, root, ".py")], "below string")
    files = files.select(below.alias("below"), "content").unionByName(blank.withColumn("content", F.lit(b"")))
    parts = F.split("below", "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    pruned = F.exists(folders, lambda f: f.isin(*SKIPPED_FOLDERS) | f.startswith("."))
    kept = files.filter(~pruned & ~name.startswith("test_") & ~name.isin(*SKIPPED_FILES))
    return kept.select(F.col("below").alias("path"), _utf8("content").alias("source"))


def script_check(spark: SparkSession, path: str | None) -> tuple[bool, str | None]:
    """Whether a path names a Python script that can be read, and if not, why."""
    if not (path or "").strip():
        return False, "a script path is required"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(place):
        return False, f"no such script: {path}"
    if not path.endswith(".py"):
        return False, "only Python (.py) files can be checked"
    try:
        store.open(place).close()
    except Exception as e:
        return False, f"the script can't be read: {e}"
    return True, None


class _Markdown(HTMLParser):
    HEADS = {f"h{i}": "#" * i for i in range(1, 7)}
    SKIP = {"script", "style", "head", "noscript", "template"}
    BREAKS = {"p", "div", "section", "article", "ul", "ol", "table", "blockquote", "nav", "footer", "header", "main"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.pre = 0
        self.href: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.HEADS:
            self.out.append(f"\n\n{self.HEADS[tag]} ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "tr":
            self.out.append("\n| ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and not self.pre:
            self.href = dict(attrs).get("href")
            self.out.append("[")
        elif tag in self.BREAKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in self.HEADS or tag in self.BREAKS:
            self.out.append("\n\n")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and not self.pre:
            self.out.append(f"]({self.href or ''})")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else " ".join(data.split()) if data.strip() == data else f" {' '.join(data.split())} ".replace("  ", " "))


def markdown_of(html: str) -> str:
    import re

    parser = _Markdown()
    parser.feed(html)
    parser.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def with_markdown(pages: DataFrame, html: str = "html", out: str = "markdown") -> DataFrame:
    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda h: markdown_of(h or ""))

    return pages.withColumn(out, convert(F.col(html)))
