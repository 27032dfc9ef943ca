"""A graph of repositories that is kept, and follows its checkouts.

What the parse finds lies in a store of versions, by file (repository and
path). Analysing a checkout hashes its files, parses those whose text or module
changed, and commits them with the removal of those that are gone as one load;
a second run over the same files parses nothing. Nodes merge when the graph is
read: a class is one by its full name, a method or attribute by its class and
name, a function by its file and name, the first in order of repository, path
and line standing. Import edges are an equi-join of what is kept, so they are
those of a graph that was built anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions.text import line_count
from strataweave.operators import graph, python_code, validation
from strataweave.operators.chunk_store import ChunkStore
from strataweave.shared import kept

ROWS = "file string, nth bigint, repo_name string, path string, kind string, name string, full_name string, owner string, line int, args array<string>, params_detailed array<string>, type string, hash string"


def named(files: DataFrame) -> DataFrame:
    """files (path, source) with their module and a hash of both."""
    folders = files.filter(F.col("path").endswith("/__init__.py")).agg(F.array_sort(F.collect_set(F.regexp_replace("path", "/__init__.py$", ""))).alias("dirs"))
    held = files.crossJoin(F.broadcast(folders)).withColumn("module", python_code.module_name(F.col("path"), F.col("dirs"))).drop("dirs")  # one row
    return held.withColumn("hash", F.sha2(F.concat_ws("\n", "module", "source"), 256))


def parsed(files: DataFrame, repo: str) -> DataFrame:
    """ROWS of named() files: one of kind 'file' for each, named as its module, with its lines, and one for all that is in it."""
    found = python_code.structure(files.select("path", "source", "module")).select("path", "kind", "name", "full_name", "owner", "line", "args", "params_detailed", "type", F.lit(None).cast("string").alias("hash"))
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    own = files.select("path", F.lit("file").alias("kind"), F.col("module").alias("name"), F.col("module").alias("full_name"), text.alias("owner"), line_count(F.col("source")).cast("int").alias("line"), none.alias("args"), none.alias("params_detailed"), text.alias("type"), "hash")
    rows = found.unionByName(own).withColumns({"repo_name": F.lit(repo), "file": F.concat(F.lit(repo + "::"), "path"), "nth": F.monotonically_increasing_id()})
    return rows.select(*(c.split(" ")[0] for c in ROWS.split(", ")))


def assembled(rows: DataFrame) -> graph.Graph:
    """The graph of ROWS of any number of repositories."""
    of = lambda kind: rows.filter(F.col("kind") == kind)
    first = F.struct("repo_name", "path", "line", "nth")

    def merged(df: DataFrame, key: list[str], **more: str) -> DataFrame:
        """One row for each key, the first in order."""
        pick = F.min_by(F.struct(*(F.col(c).alias(n) for n, c in more.items())), first).alias("x")
        return df.groupBy(*key).agg(pick).select(*key, *(f"x.{n}" for n in more))

    signature = {"params_list": "args", "params_detailed": "params_detailed", "return_type": "type"}
    file = of("file").select("repo_name", "path", F.col("name").alias("module_name"), F.col("line").alias("line_count"))
    methods = merged(of("method"), ["owner", "name"], full_name="full_name", **signature).withColumnRenamed("owner", "class_name")
    attributes = merged(of("attribute"), ["owner", "name"], full_name="full_name", type="type").withColumnRenamed("owner", "class_name")
    functions = merged(of("function"), ["repo_name", "path", "name"], full_name="full_name", **signature).withColumnRenamed("path", "file_path")
    imports = of("import").select("repo_name", "path", F.col("name").alias("module")).withColumn("_own", validation.own_import(F.col("module")))
    # What the name alone doesn't tell: whether it begins with the first segment of a module, met by its prefixes.
    tops = file.select("repo_name", F.split_part("module_name", F.lit("."), F.lit(1)).alias("_top")).distinct()
    unsure = imports.filter("_own IS NULL").withColumn("_top", F.explode(F.concat(F.array(F.lit("")), graph.prefixes(F.col("module")))))
    internal = imports.filter("_own").select("path", "module").unionByName(unsure.join(tops, ["repo_name", "_top"], "left_semi").select("path", "module").distinct())
    return graph.Graph(
        rows.select(F.col("repo_name").alias("name")).distinct(), file, of("class").select("repo_name", F.col("path").alias("file_path"), "full_name", "name").distinct(),
        methods, attributes, functions, graph.import_edges(internal, file),
    )


class GraphStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.store = ChunkStore(spark, folder, ROWS, url="file", key=("file", "nth"))

    def graph(self, version: int | None = None) -> graph.Graph:
        """Each of the graph's tables reads the rows, so they are merged once."""
        return assembled(kept(self.store.rows(version), "graph"))

    def analyse(self, files: DataFrame, repo: str) -> DataFrame:
        """Brings a repository up to its files (path, source). One row: repo_name, files, parsed (files that
        were), removed, and classes, methods, functions and imports that the repository has now."""
        now = named(files)
        known = self.store.rows().filter((F.col("repo_name") == repo) & (F.col("kind") == "file")).select("path", "hash")
        # Parsing costs far more than moving sources: a table that is one split is parsed by all cores.
        changed = now.join(known, ["path", "hash"], "left_anti").repartition(3 * files.sparkSession.sparkContext.defaultParallelism, "path")
        gone = known.join(now.select("path"), "path", "left_anti")
        made = kept(parsed(changed, repo), "parsed")
        dropped = kept(gone.select(F.concat(F.lit(repo + "::"), "path").alias("file")), "gone")
        n_parsed, n_gone = made.filter("kind = 'file'").count(), dropped.count()
        if n_parsed or n_gone:
            self.store.load(made, replace=True, deletes=dropped)
        n = lambda kind: F.count_if(F.col("kind") == kind)
        counts = [n("file").alias("files"), F.lit(n_parsed).cast("bigint").alias("parsed"), F.lit(n_gone).cast("bigint").alias("removed"), *(n(k).alias(p) for k, p in (("class", "classes"), ("method", "methods"), ("function", "functions"), ("import", "imports")))]
        return self.store.rows().filter(F.col("repo_name") == repo).agg(*counts).select(F.lit(repo).alias("repo_name"), "*")

    def clear(self, repo: str) -> None:
        """Removes a repository and all below it, as one load."""
        rows = self.store.rows().filter(F.col("repo_name") == repo)
        self.store.load(rows.limit(0), deletes=rows.select("file"))


def conflicts(g: graph.Graph) -> DataFrame:
    """repo_name, path, n of files that are in a repository more than once: none in a graph that was kept."""
    return g.file.groupBy("repo_name", "path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
