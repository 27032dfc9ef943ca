"""The engine's tools: the calls that a client makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave import shared
from strataweave.functions import text as T
from strataweave.functions import urls
from strataweave.operators import crawl, graph, graph_store, python_code, retrieval, validation
from strataweave.operators import embedding as E
from strataweave.plans import resumable
from strataweave.plans.config import EngineConfig
from strataweave.plans.ingest import Corpus, ingest
from strataweave.sources import files


def vector_of(spark: SparkSession, embedder: E.Embedder, question: str) -> list[float]:
    """One row through the embedder, once per question."""
    return list(spark.createDataFrame([(question,)], "q string").select(embedder(F.col("q")).alias("v")).first()["v"])


def crawl_single_page(pages: DataFrame, url: str, config: EngineConfig, embedder: E.Embedder) -> Corpus:
    """pages: url, html, of which one is taken."""
    return ingest(files.with_markdown(pages.filter(F.col("url") == url)).filter(F.trim("markdown") != ""), config, embedder)


def smart_crawl(pages: DataFrame, start: str, config: EngineConfig, embedder: E.Embedder, max_depth: int = 3) -> Corpus:
    """A text file as it is, the pages of a sitemap, or pages linked from a start."""
    spark = pages.sparkSession
    first = spark.createDataFrame([(start,)], "url string")
    if start.endswith(".txt"):
        return ingest(pages.filter(F.col("url") == start).withColumn("markdown", F.col("html")), config, embedder, "text_file")
    if spark.range(1).select(urls.is_sitemap(F.lit(start))).first()[0]:
        listed = pages.filter(F.col("url") == start).select(F.explode(crawl.sitemap_links(F.col("html"))).alias("url"))
        return ingest(files.with_markdown(pages.join(listed.distinct(), "url")), config, embedder, "sitemap")
    reached = crawl.crawl(crawl.page_links(pages), first, max_depth).select(F.col("url").alias("_u"))
    found = pages.withColumn("_u", urls.defragmented(F.col("url"))).join(reached, "_u").drop("_u")
    return ingest(files.with_markdown(found).filter(F.trim("markdown") != ""), config, embedder, "webpage")


def get_available_sources(corpus: Corpus) -> DataFrame:
    return corpus.sources.orderBy("source_id")


def perform_rag_query(corpus: Corpus, question: str, config: EngineConfig, embedder: E.Embedder, kind: str = "all", k: int = 5) -> DataFrame:
    """url, content, metadata, similarity and, if reranked, rerank_score."""
    vector = vector_of(corpus.chunks.sparkSession, embedder, question)
    inside, outside = retrieval.sources_for(kind)
    chunks = corpus.chunks.filter(~F.col("source_id").isin(*outside)) if outside else corpus.chunks
    if inside is not None and len(inside) > 1:
        found = retrieval.multi_source(chunks, vector, inside, k, question if config.hybrid_search else None)
    else:
        found = retrieval.search(chunks, vector, question, k, inside[0] if inside else None, config.hybrid_search)
    shaped = ["id", "url", "content", "metadata", "similarity"]
    if config.reranking:
        return retrieval.rerank(found, question, E.word_overlap).select(*shaped, "rerank_score")
    return found.select(*shaped)


def search_code_examples(corpus: Corpus, question: str, config: EngineConfig, embedder: E.Embedder, source: str | None = None, k: int = 5) -> DataFrame:
    """url, code, summary, metadata, source_id, similarity."""
    if not config.agentic_rag:
        raise ValueError("code example search is off")
    spark = corpus.code_examples.sparkSession
    worded = spark.range(1).select(T.code_query(F.lit(question)).alias("q")).first()["q"]
    vector = vector_of(spark, embedder, worded)
    if config.hybrid_search:
        found = retrieval.search_code(corpus.code_examples, vector, question, k, source)
    else:
        found = retrieval.match(corpus.code_examples, vector, k, source=source)
    found = retrieval.rerank(found, question, E.word_overlap) if config.reranking else found
    return found.select("id", "url", F.col("content").alias("code"), "summary", "metadata", "source_id", "similarity")


def query_code(corpus: Corpus, question: str, embedder: E.Embedder, source: str | None = None, kind: str = "all", k: int = 5, docs_source: str | None = None) -> DataFrame:
    """Code examples by vector: of a source, or of the sources of a kind of question.

    `docs` means the one documentation source alone. url, code, summary, language, source_id, similarity.
    """
    spark = corpus.code_examples.sparkSession
    vector = vector_of(spark, embedder, spark.range(1).select(T.code_query(F.lit(question)).alias("q")).first()["q"])
    inside, outside = retrieval.sources_for(kind)
    examples = corpus.code_examples
    if source is not None:
        examples = examples.filter(F.col("source_id") == source)
    elif kind == "docs" and docs_source is not None:
        examples = examples.filter(F.col("source_id") == docs_source)
    elif inside is not None or outside:
        examples = examples.filter(F.col("source_id").isin(*inside) if inside is not None else ~F.col("source_id").isin(*outside))
    found = retrieval.match(examples, vector, k)
    return found.select("url", F.col("content").alias("code"), "summary", F.coalesce(F.get_json_object("metadata", "$.language"), F.lit("")).alias("language"), "source_id", "similarity")


def parse_repository(spark: SparkSession, root: str, name: str) -> graph.Graph:
    """The graph of a local checkout."""
    return graph_store.assembled(shared.kept(graph_store.parsed(graph_store.named(files.repository(spark, root)), name), "repository"))


KINDS = {"method_call": "method", "attribute": "attribute", "import": "import", "import_from": "import"}


def usages_checked(scripts: DataFrame, g: graph.Graph) -> DataFrame:
    """script, seq, line, kind, name, of, status, confidence, in_graph of every usage and import.

    A script's own facts (types, imports) come with its rows from the parse. The
    graph is asked once for each distinct (kind, owner, member), not for each
    usage, and its answers, far fewer, are joined to the usages as they lie.
    """
    uses = python_code.usage(scripts).filter("kind <> 'error'").withColumnRenamed("path", "script")
    kind = F.coalesce(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[F.col("kind")], F.when(F.col("instance"), "class").otherwise("function"))
    member = kind.isin("method", "attribute")
    called = F.coalesce(F.nullif("full_name", F.lit("")), "name")
    uses = uses.select("script", "seq", "line", kind.alias("kind"), "name", "full_name", F.when(member, F.col("object_type")).otherwise(called).alias("owner"), F.when(member, F.col("name")).otherwise("").alias("member"), "args", "kwargs", "imported")
    uses = shared.kept(uses, "usages")
    wanted = uses.select("kind", "owner", "member").filter("owner IS NOT NULL").distinct()
    of_class = g.class_.select(F.col("full_name").alias("class_name"), "repo_name").distinct()
    methods = g.method.select("class_name", "name", graph.parameters().alias("params")).join(of_class, "class_name")
    held = lambda df, kind, owner, name, params: df.select(F.lit(kind).alias("kind"), F.col(owner).alias("owner"), name.alias("member"), params.alias("params"), "repo_name")
    none, no_name = F.lit(None).cast("array<string>"), F.lit("")
    inits = methods.filter("name = '__init__'").select(F.col("class_name").alias("full_name"), "params")
    members = held(methods, "method", "class_name", F.col("name"), F.col("params"))
    members = members.unionByName(held(methods.select("class_name", "name", "repo_name").unionByName(g.attribute.join(of_class, "class_name").select("class_name", "name", "repo_name")).distinct(), "attribute", "class_name", F.col("name"), none))
    members = members.unionByName(held(g.class_.join(inits, "full_name", "left"), "class", "full_name", no_name, F.col("params")))
    members = members.unionByName(held(g.function.withColumn("params", graph.parameters()), "function", "full_name", no_name, F.col("params")))
    repositories = graph.repositories_for(g, wanted.select(validation.module_of(F.col("owner")).alias("module")))
    found = validation.looked_up(wanted, "owner", members, repositories, ("kind", "member"))
    tops = g.file.select(validation.head(F.col("module_name")).alias("_top")).distinct().withColumn("_in_graph", F.lit(True))
    top = F.when(F.col("owner").contains("."), validation.head(F.col("owner"))).otherwise(F.col("owner"))
    answers = found.withColumn("_top", top).join(tops, "_top", "left").select("kind", "owner", "member", "params", "found", F.col("_top").alias("top"), F.coalesce("_in_graph", F.lit(False)).alias("top_known"))
    met = uses.join(shared.kept(answers, "answers"), ["kind", "owner", "member"], "left")
    # As known modules go, an import is of its first segment, whatever its name.
    imports = F.col("kind") == "import"
    known = F.when(imports, F.coalesce("top_known", F.lit(False))).otherwise(F.coalesce(F.col("top_known") & F.array_contains("imported", F.col("top")), F.lit(False)))
    met = met.withColumn("known", known)
    check = validation.parameter_check(F.col("params"), F.size("args"), F.map_keys("kwargs"))
    judged = validation.verdict(F.col("kind"), F.col("owner"), F.col("full_name"), F.col("known"), F.coalesce("found", F.lit(False)), check)
    of = F.when(F.col("kind").isin("class", "function"), F.col("full_name")).otherwise(F.col("owner"))
    return met.select(
        "script", "seq", "line", "kind", "name", of.alias("of"), F.when(imports, F.when(F.col("known"), validation.VALID).otherwise(validation.UNCERTAIN)).otherwise(judged["status"]).alias("status"),
        F.when(imports, F.when(F.col("known"), 0.9).otherwise(0.8)).otherwise(judged["confidence"]).alias("confidence"), (F.col("known") & of.isNotNull()).alias("in_graph"),
    )


def check_scripts(scripts: DataFrame, g: graph.Graph) -> dict[str, DataFrame]:
    """scripts: path, source. All scripts at once: `scripts` is a row per script with all that a report holds,
    kept in the shared folder; imports, validations, hallucinations, summary, confidence, recommendations and libraries are read from it."""
    done = shared.kept(validation.by_script(usages_checked(scripts, g), scripts.select(F.col("path").alias("script")).distinct()), "checked-scripts")
    items = done.select("script", F.explode("items").alias("i")).select("script", "i.*")
    rows = items.filter("kind <> 'import'").drop("seq")
    imports = items.filter("kind = 'import'").select("script", F.coalesce(F.nullif("of", F.lit("")), "name").alias("module"), "in_graph", "status", "confidence").distinct()
    return {
        "scripts": done, "imports": imports, "validations": rows, "hallucinations": done.select("script", F.explode("hallucinations").alias("h")).select("script", "h.*"),
        "summary": done.select("script", "total", "valid", "invalid", "uncertain", "not_found", "hallucination_rate"), "confidence": done.select("script", "confidence"),
        "recommendations": done.select("script", "recommendations"), "libraries": validation.libraries(rows.filter("in_graph").withColumn("module", validation.head(F.col("of")))),
    }


def reports(results: dict[str, DataFrame], text: bool = False) -> DataFrame:
    """script and its report as JSON, or as Markdown."""
    if text:
        return validation.markdown(results["scripts"])
    listed = lambda test: F.transform(F.filter("items", test), lambda x: x.dropFields("seq"))
    made = results["scripts"].withColumn("imports", listed(lambda x: (x["kind"] == "import") & x["in_graph"])).withColumn("details", listed(lambda x: x["kind"] != "import")).drop("items")
    return made.select("script", F.to_json(F.struct(*made.columns)).alias("report"))


def query_graph(g: graph.Graph, command: str) -> DataFrame:
    return graph.run(g, command)


def write_url_lists(links: DataFrame, folder: str) -> None:
    """links: url. As a JSON table, as file:// names of saved pages, and as a sitemap text."""
    links.select("url").write.mode("overwrite").json(f"{folder}/urls")
    links.select(F.concat(F.lit("file://"), urls.page_file_name(F.col("url"))).alias("value")).write.mode("overwrite").text(f"{folder}/local_urls")
    links.select(F.col("url").alias("value")).write.mode("overwrite").text(f"{folder}/sitemap")


def offline_pipeline(spark: SparkSession, index_html: DataFrame, base: str, saved_pages: str, folder: str, config: EngineConfig, embedder: E.Embedder, skip: tuple[str, ...] = (), limit: int | None = None) -> Corpus | None:
    """Extract links of an index page, list them, ingest saved pages into stores that follow them (changed pages only,
    and what an earlier run has left undone). skip: extract, crawl, store."""
    if "extract" not in skip:
        links = index_html.select(F.explode(crawl.index_links(F.col("html"), base)).alias("url")).distinct().orderBy("url")
        write_url_lists(links if limit is None else links.limit(limit), folder)
    if "crawl" in skip:
        return None
    pages = files.html_pages(spark, saved_pages).withColumn("url", F.concat(F.lit("local://"), F.regexp_replace("file_name", r"\.html$", "")))
    if "store" in skip:
        return ingest(files.with_markdown(pages).select("url", "markdown"), config, embedder)
    kept_tables = resumable.Ingest(spark, f"{folder}/tables", config, embedder)
    kept_tables.run(pages)
    return kept_tables.corpus()
