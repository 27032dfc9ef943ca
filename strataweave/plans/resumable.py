"""Ingest that takes up where it stopped, and does again only what changed.

Pages, chunks, sources and code examples are stores of versions. Each but the
first follows another: its version tells up to which version of the one before
it has come, and a step compares that version with the last, takes the rows
that differ, and commits its own change together with the new mark. So a run
that is stopped, wherever, is finished by the next, and a run over the same
pages changes nothing.

A step may be stopped in the middle of its work (nothing is committed) or
between two steps (the marks differ); both leave the stores readable.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import urls
from strataweave.operators.chunk_store import ChunkStore
from strataweave.operators.embedding import Embedder
from strataweave.plans.config import EngineConfig
from strataweave.plans.ingest import Corpus, ingest, source_table
from strataweave.shared import kept
from strataweave.sources import files

PAGES = "url string, hash string, markdown string"
STEPS = ("pages", "chunks", "sources", "code_examples")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class Ingest:
    def __init__(self, spark: SparkSession, folder: str, config: EngineConfig, embedder: Embedder, crawl_type: str = "webpage") -> None:
        self.spark, self.config, self.embedder, self.crawl_type = spark, config, embedder, crawl_type
        none = self._ingested(spark.createDataFrame([], "url string, markdown string"))
        place = lambda name: f"{folder.rstrip('/')}/{name}"
        self.pages = ChunkStore(spark, place("pages"), PAGES, key=("url",))
        self.chunks = ChunkStore(spark, place("chunks"), _ddl(none.chunks))
        self.sources = ChunkStore(spark, place("sources"), _ddl(none.sources), url="source_id", key=("source_id",))
        self.code_examples = ChunkStore(spark, place("code_examples"), _ddl(none.code_examples))

    def _ingested(self, pages: DataFrame) -> Corpus:
        return ingest(pages.select("url", "markdown"), self.config, self.embedder, self.crawl_type)

    def corpus(self) -> Corpus:
        return Corpus(self.chunks.rows(), self.sources.rows(), self.code_examples.rows())

    def _take(self, pages: DataFrame, part: bool) -> int:
        """The pages store brought up to pages (url and markdown, or html); with part, others stay as they are."""
        text = "markdown" if "markdown" in pages.columns else "html"
        now = pages.select("url", F.col(text).alias("_text")).filter("url IS NOT NULL").dropDuplicates(["url"]).withColumn("hash", F.sha2(F.coalesce("_text", F.lit("")), 256))
        known = self.pages.rows().select("url", "hash")
        changed = now.join(known, ["url", "hash"], "left_anti")
        # Only what changed is converted.
        made = changed.withColumnRenamed("_text", "markdown") if text == "markdown" else files.with_markdown(changed.withColumnRenamed("_text", "html"))
        touched = kept(changed.select("url"), "changed-pages")
        gone = kept(known.join(now.select("url"), "url", "left_anti").select("url") if not part else known.limit(0).select("url"), "gone-pages")
        n = touched.count() + gone.count()
        if n:
            self.pages.load(made.select("url", "hash", "markdown"), deletes=gone)
        return n

    def _changes(self, store: ChunkStore) -> tuple[int, DataFrame, DataFrame] | None:
        """The last version of the pages, the pages that are new or changed since the one that store follows, and the URLs that were there then and differ now."""
        last, done = self.pages.version().number, store.version().streams.get("pages", 0)
        if done >= last:
            return None
        old, new = self.pages.rows(done), self.pages.rows(last)
        return last, new.join(old.select("url", "hash"), ["url", "hash"], "left_anti"), old.join(new.select("url", "hash"), ["url", "hash"], "left_anti").select("url")

    def _follow(self, name: str) -> int:
        store = getattr(self, name)
        found = self._changes(store)
        if found is None:
            return 0
        last, changed, stale = found
        # Written once, into the store itself: texts and vectors are the bulk of it.
        return store.loaded(store.load(getattr(self._ingested(changed.filter("markdown <> ''")), name), deletes=stale, stream=("pages", last)))

    def _follow_sources(self) -> int:
        """Sources of changed pages, summed up anew over all of their chunks."""
        found = self._changes(self.sources)
        if found is None:
            return 0
        last, changed, stale = found
        touched = kept(changed.select("url").unionByName(stale).select(urls.source_id(F.col("url")).alias("source_id")).distinct(), "touched-sources")
        rows = self.chunks.rows().join(touched, "source_id", "left_semi")
        pages = self.pages.rows(last).withColumn("source_id", urls.source_id(F.col("url"))).join(touched, "source_id", "left_semi")
        made = kept(source_table(rows, pages), "made-sources")
        self.sources.load(made, deletes=touched, stream=("pages", last))
        return made.count()

    def steps(self, pages: DataFrame | None = None, part: bool = False) -> Iterator[tuple[str, int]]:
        """Each step's name and how many rows it has made, as they are done; without pages, only what was left undone."""
        yield "pages", 0 if pages is None else self._take(pages, part)
        yield "chunks", self._follow("chunks")
        yield "sources", self._follow_sources()
        yield "code_examples", self._follow("code_examples")

    def run(self, pages: DataFrame | None = None, part: bool = False) -> dict[str, int]:
        return dict(self.steps(pages, part))

    def tidy(self) -> None:
        """Merges the stores once all of them are up to date, and drops their earlier versions."""
        last = self.pages.version().number
        if all(getattr(self, s).version().streams.get("pages", 0) == last for s in STEPS[1:]):
            for name in STEPS[1:]:
                getattr(self, name).compact()
                getattr(self, name).forget(1)
            self.pages.forget(1)
