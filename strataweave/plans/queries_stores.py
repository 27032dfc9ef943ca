"""Registered queries of what is kept and kept up: indexes, the chunk store, streams into it, the waiting limiter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave import shared
from strataweave.operators import graph_store, metadata_index, retrieval, text_index, vector_index
from strataweave.operators.chunk_store import ChunkStore
from strataweave.operators import embedding
from strataweave.plans import derived as D
from strataweave.plans import resumable
from strataweave.plans.config import EngineConfig
from strataweave.plans.registry import CHUNKS, QUERY, SIM, query, requests, six
from strataweave.streaming import incremental, limiter

# --- indexes ---------------------------------------------------------------------


@query(f"{CHUNKS} SELECT id, url, chunk_number, content, source_id, round({SIM}, 6) AS similarity FROM chunks, {QUERY} ORDER BY {SIM} DESC NULLS LAST, id LIMIT 10")
def snk_11_vector_index(spark: SparkSession, d: str) -> DataFrame:
    """All chunks in inverted lists; the search reads the lists that an exact answer needs."""
    index = vector_index.build(D.chunks(spark, d), shared.fresh_path(spark, "vectors"), lists=16)
    return six(index.match(D.query_vector(spark, d), 10).drop("metadata"), "similarity")


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
r AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC NULLS LAST, vec_id) AS n FROM embeddings, q)
SELECT query_id, id, similarity FROM r WHERE n <= 3""")
def snk_11_vector_index_of_grown_table(spark: SparkSession, d: str) -> DataFrame:
    """Half of the vectors are indexed at first, the others come later; every hundredth vector asks."""
    rows = D.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = vector_index.build(rows.filter("id % 2 = 0"), shared.fresh_path(spark, "vectors"), lists=8)
    index.add(rows.filter("id % 2 = 1"))
    return six(index.match_all(rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 3).select("query_id", "id", "similarity"), "similarity")


@query(f"{CHUNKS} SELECT id FROM chunks WHERE source_id = 'src2' AND chunk_number = 1")
def flt_01_indexed_containment(spark: SparkSession, d: str) -> DataFrame:
    rows = D.chunks(spark, d)
    index = metadata_index.build(rows, shared.fresh_path(spark, "postings"))
    return index.find(rows, {"source": "src2", "chunk": {"index": 1}}).select("id")


@query(f"{CHUNKS} SELECT id, round({SIM}, 6) AS similarity FROM chunks, {QUERY} WHERE source_id = 'src3' ORDER BY {SIM} DESC NULLS LAST, id LIMIT 10")
def rag_01_match_by_indexed_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chunks found by their postings, then by similarity."""
    rows = D.chunks(spark, d)
    index = metadata_index.build(rows, shared.fresh_path(spark, "postings"))
    return six(retrieval.match(index.find(rows, {"source": "src3"}), D.query_vector(spark, d), 10).select("id", "similarity"), "similarity")


@query(f"{CHUNKS} SELECT 'plain' AS how, id FROM chunks WHERE content ILIKE '%anes%' UNION ALL SELECT 'wild', id FROM chunks WHERE content ILIKE '%the %_nd %' UNION ALL SELECT 'short', id FROM chunks WHERE content ILIKE '%qu%'")
def rag_05_indexed_keywords(spark: SparkSession, d: str) -> DataFrame:
    """All chunks in posting lists of trigrams, asked for a part of a word, for parts with wildcards between, and for too short a part to have a trigram."""
    rows = D.texts(spark, d)
    index = text_index.build(rows, shared.fresh_path(spark, "trigrams"))
    found = [index.find(rows, q).select(F.lit(how).alias("how"), "id", *D.PLACE) for how, q in (("plain", "ANES"), ("wild", "the %_nd "), ("short", "qu"))]
    # A chunk comes as often as it has vectors. They meet what is found, so that texts aren't shuffled.
    return found[0].unionByName(found[1]).unionByName(found[2]).join(D.vectors(spark, d), D.PLACE, "left").select("how", "id")


# --- the chunk store -------------------------------------------------------------------

STORED = "url string, chunk_number int, content string"


def pages(docs: DataFrame, every: int | None = None) -> DataFrame:
    """url and text; with every, documents share the URLs of so many."""
    number = F.col("doc_id") if every is None else F.col("doc_id") % every
    return docs.select("doc_id", F.concat(F.lit("https://"), "source", F.lit(".example.com/doc/"), number.cast("string")).alias("url"), "text", "source", "lang")


@query(f"""{CHUNKS}, kept AS (SELECT c.url, chunk_number, content, lang, source FROM chunks c JOIN documents ON doc_id = c.id // {D.PER_DOCUMENT})
SELECT 'first' AS version, url, chunk_number, content FROM kept
UNION ALL SELECT unnest(['merged', 'compacted']), url, chunk_number, CASE WHEN lang IS DISTINCT FROM 'en' THEN 'again ' || content ELSE content END FROM kept
  WHERE source <> 'src3' AND NOT (lang IS DISTINCT FROM 'en' AND source = 'src4' AND chunk_number > 0)
UNION ALL SELECT unnest(['merged', 'compacted']), 'https://src3.example.com/new', 0, 'one'""")
def snk_01_versions_of_the_store(spark: SparkSession, d: str) -> DataFrame:
    """All chunks; then those of other languages than English anew, and one source's URLs deleted and
    another's cut to their first chunk; then one URL comes back. The first version stays readable."""
    store = ChunkStore(spark, shared.fresh_path(spark, "store"), STORED)
    docs = D.table(spark, d, "documents")
    rows = D.chunks(spark, d).select("url", "chunk_number", "content", "source_id")
    other = rows.join(pages(docs).filter("NOT lang <=> 'en'").select("url"), "url", "left_semi").withColumn("content", F.concat(F.lit("again "), "content"))
    first = store.load(rows)
    store.load(other.filter("source_id <> 'src4'"))
    store.load(other.filter("source_id = 'src4' AND chunk_number = 0"), replace=True)
    store.load(rows.limit(0), deletes=rows.filter("source_id = 'src3'").select("url"))
    store.load(spark.createDataFrame([("https://src3.example.com/new", 0, "none"), ("https://src3.example.com/new", 0, "one")], STORED), position=F.when(F.col("content") == "one", 2).otherwise(1))
    merged = store.rows()
    store.compact()
    tell = lambda df, name: df.select(F.lit(name).alias("version"), "url", "chunk_number", "content")
    return tell(store.rows(first.number), "first").unionByName(tell(merged, "merged")).unionByName(tell(store.rows(), "compacted"))


@query(f"""WITH RECURSIVE {D.PAGES_SQL.replace("doc_id, source AS source_id, 'https://' || source || '.example.com/doc/' || doc_id AS url, text FROM documents",
  "doc_id, source AS source_id, 'https://' || source || '.example.com/doc/' || (doc_id % 40) AS url, text FROM documents QUALIFY row_number() OVER (PARTITION BY source, doc_id % 40 ORDER BY doc_id % 3 DESC, doc_id DESC) = 1")},
{D.chunks_sql().partition("spans AS")[1]}{D.chunks_sql().partition("spans AS")[2]} SELECT url, chunk_number, content FROM chunks""")
def stm_01_streamed_upserts(spark: SparkSession, d: str) -> DataFrame:
    """All documents as a stream of three loads, with URLs that recur within and across them; of each the last text stands."""
    place = shared.fresh_path(spark, "upserts")
    docs = pages(D.table(spark, d, "documents"), 40)
    for load in range(3):  # a URL lies in one file of a load, and files come in the order in which they were written
        docs.filter(F.col("doc_id") % 3 == load).select("doc_id", "url", "text").repartition(2, "url").write.mode("append").parquet(f"{place}/in")
    stream = spark.readStream.schema("doc_id bigint, url string, text string").option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    store = ChunkStore(spark, f"{place}/chunks", incremental.CHUNKS)
    incremental.stream_upserts(stream, store, f"{place}/log", D.SIZE, order="doc_id", compact_after=4).awaitTermination()
    return store.rows()


# --- the limiter that waits ---------------------------------------------------------------


@query("""WITH RECURSIVE r AS (SELECT event_id AS id, user_id AS client, epoch_us(ts)::BIGINT AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT client, id, n, t AS gone, [t] AS times, CASE WHEN ok THEN 0 ELSE 1 END AS errors, CASE WHEN ok THEN 0 ELSE t END AS failed FROM r WHERE n = 1
  UNION ALL
  SELECT client, id, n, gone, times[-2:] || [now], CASE WHEN ok THEN 0 ELSE e + 1 END, CASE WHEN ok THEN f ELSE gone END
  FROM (SELECT *, CASE WHEN e > 0 THEN greatest(now, f + least(pow(2, e), 30)::BIGINT * 1000000) ELSE now END AS gone
    FROM (SELECT r.*, s.times, s.errors AS e, s.failed AS f, greatest(r.t, s.gone, coalesce(s.times[-3], 0) + 60000000, coalesce(s.times[-2], 0) + 10000000) AS now FROM s JOIN r ON r.client = s.client AND r.n = s.n + 1))
)
SELECT id, client, gone AS released FROM s""")
def stm_02_released_requests(spark: SparkSession, d: str) -> DataFrame:
    """All events as requests that wait for their turn: three a minute, two in ten seconds. A last bell, a day later, lets the watermark pass them all."""
    place = shared.fresh_path(spark, "released")
    last = D.table(spark, d, "events").agg(F.max("event_id")).first()[0]
    own = F.struct("client", "id", "ts", "ok", "status")
    bell = F.struct(F.col("client"), F.lit(-1).cast("bigint").alias("id"), (F.col("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"), F.lit(True).alias("ok"), F.lit(200).alias("status"))
    rows = requests(spark, d, D.stream(spark, d, "events"))
    rung = rows.select(F.explode(F.when(F.col("id") == last, F.array(own, bell)).otherwise(F.array(own))).alias("r")).select("r.*")
    made = limiter.limited(rung, 3, 2, "40 days").writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/log")
    with limiter.state_store(spark):
        made.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/rows").filter("id >= 0").select("id", "client", F.unix_micros("released_at").alias("released"))


# --- a graph that is kept -----------------------------------------------------------------

#: A module of each document: a class with two methods, of which one is there twice, a function, and an import of another document's.
MODULE = "from mod{o} import A{o}\nimport os\nclass A{n}:\n    x: int = {v}\n    def go(self, a, b=2): ...\n    def go(self): ...\n    def stop{v}(self): ...\ndef top(n): ...\n"


def modules(spark: SparkSession, d: str, version: int) -> DataFrame:
    """path and source for each document; the second version changes every third and leaves every fifth out."""
    docs = D.table(spark, d, "documents").select("doc_id")
    docs = docs if version == 1 else docs.filter("doc_id % 5 <> 4")
    v = F.when((F.col("doc_id") % 3 == 0) & F.lit(version == 2), "2").otherwise("1")
    source = F.replace(F.replace(F.replace(F.lit(MODULE), F.lit("{n}"), F.col("doc_id").cast("string")), F.lit("{o}"), (F.col("doc_id") + 1).cast("string")), F.lit("{v}"), v)
    return docs.select(F.concat(F.lit("mod"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), source.alias("source"))


@query("""WITH n AS (SELECT count(*) AS a, count_if(doc_id % 5 <> 4) AS b, count_if(doc_id % 3 = 0 AND doc_id % 5 <> 4) AS c FROM documents)
SELECT unnest(['first', 'second', 'again']) AS run, unnest([a, b, b])::BIGINT AS files, unnest([a, c, 0])::BIGINT AS parsed, unnest([0, a - b, 0])::BIGINT AS removed, unnest([a, b, b])::BIGINT AS classes, unnest([3 * a, 3 * b, 3 * b])::BIGINT AS methods, unnest([a, b, b])::BIGINT AS functions, unnest([2 * a, 2 * b, 2 * b])::BIGINT AS imports FROM n""")
def kg_19_agg_15_analyses(spark: SparkSession, d: str) -> DataFrame:
    """Documents' modules as a repository, analysed, changed and analysed twice more: only what changed is parsed."""
    store = graph_store.GraphStore(spark, shared.fresh_path(spark, "graph"))
    runs = [store.analyse(modules(spark, d, v), "docs").withColumn("run", F.lit(name)).collect()[0] for name, v in (("first", 1), ("second", 2), ("again", 2))]  # a row each
    return spark.createDataFrame(runs, "repo_name string, files bigint, parsed bigint, removed bigint, classes bigint, methods bigint, functions bigint, imports bigint, run string").drop("repo_name")


@query("""WITH f AS (SELECT doc_id, 'mod' || doc_id AS m, CASE WHEN doc_id % 3 = 0 THEN '2' ELSE '1' END AS v FROM documents WHERE doc_id % 5 <> 4)
SELECT 'class' AS kind, m || '.A' || doc_id AS owner, '' AS member, '' AS params FROM f UNION ALL SELECT 'method', m || '.A' || doc_id, 'go', 'a:Any,b:Any=2' FROM f UNION ALL SELECT 'method', m || '.A' || doc_id, 'stop' || v, '' FROM f
UNION ALL SELECT 'attribute', m || '.A' || doc_id, 'x', '' FROM f UNION ALL SELECT 'function', m || '.top', '', 'n:Any' FROM f
UNION ALL SELECT DISTINCT 'import', a.m || '.py', b.m || '.py', '' FROM f a JOIN f b ON starts_with(b.m, 'mod' || (a.doc_id + 1))""")
def snk_04_kept_graph(spark: SparkSession, d: str) -> DataFrame:
    """The graph after a change, with a second repository that came and was cleared: nodes merged, the first of a name standing, and import edges by prefix."""
    store = graph_store.GraphStore(spark, shared.fresh_path(spark, "graph"))
    store.analyse(modules(spark, d, 1), "docs")
    store.analyse(modules(spark, d, 1), "other")
    store.analyse(modules(spark, d, 2), "docs")
    store.clear("other")
    g = store.graph()
    row = lambda df, kind, owner, member=None, params=None: df.select(F.lit(kind).alias("kind"), F.col(owner).alias("owner"), (F.col(member) if member else F.lit("")).alias("member"), (F.array_join(params, ",") if params else F.lit("")).alias("params"))
    return row(g.class_, "class", "full_name").unionByName(row(g.method, "method", "class_name", "name", "params_detailed")).unionByName(row(g.attribute, "attribute", "class_name", "name")).unionByName(
        row(g.function, "function", "full_name", None, "params_detailed")).unionByName(row(g.imports, "import", "src_path", "dst_path"))


# --- ingest that goes on ----------------------------------------------------------------------


@query(f"""WITH RECURSIVE {D.chunks_sql().replace("text FROM documents)", "text FROM (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'Again. ' || text ELSE text END AS text) FROM documents WHERE doc_id % 5 <> 4))")},
s AS (SELECT source_id || '.example.com' AS source_id, sum(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')))::BIGINT AS n FROM chunks GROUP BY 1)
SELECT 'chunk' AS kind, url AS name, chunk_number::BIGINT AS n, content FROM chunks UNION ALL SELECT 'source', source_id, n, '' FROM s""")
def rag_24_resumed_ingest(spark: SparkSession, d: str) -> DataFrame:
    """All documents as pages; then a third of them changed and a fifth gone, in a run that stops between two steps and is taken up by the next."""
    place = shared.fresh_path(spark, "ingest")
    made = lambda: resumable.Ingest(spark, place, EngineConfig(chunk_size=D.SIZE), embedding.HashedWords(8))
    docs = D.table(spark, d, "documents")
    pages = lambda rows: D.as_pages(rows).select("url", F.col("text").alias("markdown"))
    made().run(pages(docs))
    later = docs.filter("doc_id % 5 <> 4").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Again. "), "text")).otherwise(F.col("text")))
    stopped = made().steps(pages(later))
    next(stopped), next(stopped)
    made().run()
    found = made().corpus()
    chunks = found.chunks.select(F.lit("chunk").alias("kind"), F.col("url").alias("name"), F.col("chunk_number").cast("bigint").alias("n"), "content")
    return chunks.unionByName(found.sources.select(F.lit("source").alias("kind"), F.col("source_id").alias("name"), F.col("total_word_count").alias("n"), F.lit("").alias("content")))
