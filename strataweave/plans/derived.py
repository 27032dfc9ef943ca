"""The engine's tables, derived from the driver's, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import text as T
from strataweave.operators.graph import Graph, import_edges

SIZE = 1000
#: No document has so many chunks or code examples, so ids of one never meet another's.
PER_DOCUMENT = 1_000_000_000
#: What names a chunk besides its id.
PLACE = ["doc_id", "chunk_number"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream. A stream's path may name a single file only by a pattern."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def as_pages(docs: DataFrame) -> DataFrame:
    """documents with the URLs that pages_of_documents() gives them."""
    return docs.withColumn("url", F.concat(F.lit("https://"), "source", F.lit(".example.com/doc/"), F.col("doc_id").cast("string")))


def pages_of_documents(spark: SparkSession, d: str, markdown: bool = False) -> DataFrame:
    docs = table(spark, d, "documents")
    text = F.col("text")
    if markdown:
        text = F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n## Part\n\n```py\n")), F.lit("\n```\n\n## End\n"))
    return docs.select("doc_id", F.col("source").alias("source_id"), F.concat(F.lit("https://"), "source", F.lit(".example.com/doc/"), F.col("doc_id").cast("string")).alias("url"), text.alias("text"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of documents, by PLACE of their first chunks."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_number"), "embedding")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """id, PLACE and content of chunks, as chunks() has them, without vectors; documents without an id have none."""
    rows = T.chunk(pages_of_documents(spark, d).select("doc_id", "text").filter(F.col("doc_id").isNotNull()), "text", SIZE)
    return rows.select((F.col("doc_id") * PER_DOCUMENT + F.col("chunk_number")).alias("id"), *PLACE, "content")


def chunks(spark: SparkSession, d: str, markdown: bool = False) -> DataFrame:
    """id, url, chunk_number, content, metadata, source_id, embedding (on first chunks)."""
    rows = T.chunk(pages_of_documents(spark, d, markdown), "text", SIZE)
    meta = F.to_json(F.struct(F.col("source_id").alias("source"), "source_id", F.struct(F.col("chunk_number").alias("index")).alias("chunk")))
    return rows.join(vectors(spark, d), PLACE, "left").select((F.col("doc_id") * PER_DOCUMENT + F.col("chunk_number")).alias("id"), "url", "chunk_number", "content", meta.alias("metadata"), "source_id", "embedding")


def examples(spark: SparkSession, d: str) -> DataFrame:
    """Code examples: fenced blocks of the markdown documents, with a summary."""
    blocks = T.code_blocks(pages_of_documents(spark, d, True), "text", 200)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("block"), "embedding")
    met = blocks.join(vectors, ["doc_id", "block"], "left")
    summary = F.concat(F.lit("Code example of "), "source_id")
    return met.select((F.col("doc_id") * PER_DOCUMENT + F.col("block")).alias("id"), "url", F.col("block").alias("chunk_number"), F.col("code").alias("content"), summary.alias("summary"), F.to_json(F.struct(F.col("source_id").alias("source"), "language")).alias("metadata"), "source_id", "embedding")


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def graph(spark: SparkSession, d: str) -> Graph:
    """Regions as repositories, nations as files, customers as classes, orders as methods."""
    low = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    file = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("repo_name"), F.concat(low("r_name"), F.lit("/"), low("n_name"), F.lit(".py")).alias("path"), F.concat(low("r_name"), F.lit("."), low("n_name")).alias("module_name"), F.col("n_nationkey").alias("line_count"))
    customer = table(spark, d, "customer").join(file, F.col("c_nationkey") == F.col("n_nationkey"))
    full = F.concat("module_name", F.lit("."), "c_name")
    class_ = customer.select("repo_name", F.col("path").alias("file_path"), full.alias("full_name"), F.col("c_name").alias("name"))
    named = customer.select("c_custkey", full.alias("class_name"))
    params = F.array(F.lit("value:float"), F.concat(F.lit("status:str="), F.col("o_orderstatus")))
    name = F.concat(F.lit("order_"), (F.col("o_orderkey") % 500).cast("string"))
    method = table(spark, d, "orders").join(named, F.col("o_custkey") == F.col("c_custkey")).select("class_name", name.alias("name"), F.concat("class_name", F.lit("."), name).alias("full_name"), params.alias("params_list"), F.when(F.col("o_orderstatus") == "F", params).otherwise(F.array().cast("array<string>")).alias("params_detailed"), F.when(F.col("o_orderstatus") == "O", "").otherwise("float").alias("return_type"))
    attribute = customer.select(full.alias("class_name"), F.lower("c_mktsegment").alias("name"), F.concat(full, F.lit("."), F.lower("c_mktsegment")).alias("full_name"), F.lit("str").alias("type"))
    function = table(spark, d, "supplier").join(file, F.col("s_nationkey") == F.col("n_nationkey")).select("repo_name", F.col("path").alias("file_path"), F.col("s_name").alias("name"), F.concat("module_name", F.lit("."), "s_name").alias("full_name"), F.array(F.lit("balance:float")).alias("params_list"), F.array(F.lit("balance:float")).alias("params_detailed"), F.lit("Any").alias("return_type"))
    files = file.drop("n_nationkey")
    wanted = file.select("path", F.split_part("module_name", F.lit("."), F.lit(1)).alias("module"))
    return Graph(region.select(F.col("r_name").alias("name")), files, class_, method, attribute, function, import_edges(wanted, files))


# The same in SQL, as common table expressions.
def rfind(g: str, part: str) -> str:
    back = f"instr(reverse({g}), reverse({part}))"
    return f"CASE WHEN {back} = 0 THEN -1 ELSE length({g}) - {back} - length({part}) + 1 END"


PAGES_SQL = "page_docs AS (SELECT doc_id, source AS source_id, 'https://' || source || '.example.com/doc/' || doc_id AS url, text FROM documents)"
MARKDOWN_SQL = """page_docs AS (SELECT doc_id, source AS source_id, 'https://' || source || '.example.com/doc/' || doc_id AS url,
  '# Document ' || doc_id || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10) || '## Part' || chr(10) || chr(10) || '```py' || chr(10)) || chr(10) || '```' || chr(10) || chr(10) || '## End' || chr(10) AS text FROM documents)"""


def chunks_sql(markdown: bool = False, size: int = SIZE) -> str:
    """WITH RECURSIVE must come before. Gives `chunks`."""
    gap, dot = "chr(10) || chr(10)", "'. '"
    cut = f"""CASE WHEN s + {size} >= length(text) THEN length(text) ELSE s + CASE
      WHEN ({rfind('g', "'```'")}) > {0.3 * size} THEN ({rfind('g', "'```'")})
      WHEN contains(g, {gap}) THEN CASE WHEN ({rfind('g', f'({gap})')}) > {0.3 * size} THEN ({rfind('g', f'({gap})')}) ELSE {size} END
      WHEN contains(g, {dot}) THEN CASE WHEN ({rfind('g', dot)}) > {0.3 * size} THEN ({rfind('g', dot)}) + 1 ELSE {size} END
      ELSE {size} END END"""
    return f"""{MARKDOWN_SQL if markdown else PAGES_SQL},
spans AS (
  SELECT doc_id, text, s, {cut} AS e FROM (SELECT doc_id, text, 0::BIGINT AS s, substr(text, 1, {size}) AS g FROM page_docs WHERE length(text) > 0)
  UNION ALL
  SELECT doc_id, text, s, {cut} AS e FROM (SELECT doc_id, text, e AS s, substr(text, e + 1, {size}) AS g FROM spans WHERE e < length(text))
), pieces AS (
  SELECT doc_id, s, e = length(text) AS final, regexp_replace(substr(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS content FROM spans
), numbered AS (
  SELECT doc_id, content, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS chunk_number FROM pieces WHERE content <> '' OR final
), chunks AS (
  SELECT doc_id * {PER_DOCUMENT} + chunk_number AS id, url, chunk_number, content, source_id, embedding::DOUBLE[] AS embedding
  FROM numbered JOIN page_docs USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id AND chunk_number = 0
)"""


GRAPH_SQL = """kg_file AS (SELECT n_nationkey, r_name AS repo_name, replace(lower(r_name), ' ', '_') || '/' || replace(lower(n_name), ' ', '_') || '.py' AS path, replace(lower(r_name), ' ', '_') || '.' || replace(lower(n_name), ' ', '_') AS module_name FROM nation JOIN region ON n_regionkey = r_regionkey),
kg_class AS (SELECT c_custkey, repo_name, path AS file_path, module_name || '.' || c_name AS full_name, c_name AS name, lower(c_mktsegment) AS attribute FROM customer JOIN kg_file ON c_nationkey = n_nationkey),
kg_method AS (SELECT full_name AS class_name, repo_name, c_custkey, kg_class.name AS class_short, 'order_' || (o_orderkey % 500) AS name, o_orderstatus AS status FROM orders JOIN kg_class ON o_custkey = c_custkey),
kg_function AS (SELECT repo_name, path AS file_path, s_name AS name FROM supplier JOIN kg_file ON s_nationkey = n_nationkey)"""
