"""A property graph of repositories as tables, and its queries.

Tables: repository(name), file(repo_name, path, module_name, line_count),
class(repo_name, file_path, full_name, name), method(class_name, name,
full_name, params_list, params_detailed, return_type), attribute(class_name,
name, full_name, type), function(repo_name, file_path, name, full_name,
params_list, params_detailed, return_type), imports(src_path, dst_path). Each
edge but an import goes from a child to one parent, so it is a column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators.text_index import containing

LIMIT = 20


@dataclass(frozen=True)
class Graph:
    repository: DataFrame
    file: DataFrame
    class_: DataFrame
    method: DataFrame
    attribute: DataFrame
    function: DataFrame
    imports: DataFrame | None = None


def repos(g: Graph) -> DataFrame:
    return g.repository.select("name").orderBy("name")


def explore(g: Graph, repo: str | None = None) -> DataFrame:
    """Files, classes, functions and methods of each repository; every branch is counted before it is joined."""
    pick = lambda df: df if repo is None else df.filter(F.col("repo_name") == repo)
    classes = pick(g.class_).select("repo_name", F.col("full_name").alias("class_name")).distinct()
    counts = [
        pick(g.file).groupBy("repo_name").agg(F.countDistinct("path").alias("files")),
        classes.groupBy("repo_name").agg(F.count(F.lit(1)).alias("classes")),
        pick(g.function).groupBy("repo_name").agg(F.countDistinct("file_path", "name").alias("functions")),
        classes.join(g.method.select("class_name", "name"), "class_name").groupBy("repo_name").agg(F.countDistinct("class_name", "name").alias("methods")),
        classes.join(g.attribute.select("class_name", "name"), "class_name").groupBy("repo_name").agg(F.countDistinct("class_name", "name").alias("attributes")),
    ]
    found = g.repository.select(F.col("name").alias("repo_name"))
    found = found if repo is None else found.filter(F.col("repo_name") == repo)
    for c in counts:
        found = found.join(c, "repo_name", "left")
    return found.na.fill(0)


def samples(values: DataFrame, by: str, value: str, n: int = 5) -> DataFrame:
    """Up to n distinct values per group, the first in order; the set is cut before it is gathered."""
    from pyspark.sql import Window

    first = values.select(by, value).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(value))).filter(F.col("_n") <= n)
    return first.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias(f"sample_{value}"))


def classes(g: Graph, repo: str | None = None, limit: int = LIMIT) -> DataFrame:
    found = g.class_ if repo is None else g.class_.filter(F.col("repo_name") == repo)
    return found.select("name", "full_name").orderBy("name", "full_name").limit(limit)


def named(column: str, full: str, name: str) -> Column:
    return (F.col(column) == name) | (F.col(full) == name)


def describe_class(g: Graph, name: str) -> DataFrame:
    """kind, name, params, type of the methods and attributes of the first class of this name."""
    found = g.class_.filter(named("name", "full_name", name)).orderBy("full_name").limit(1).select(F.col("full_name").alias("class_name"))
    methods = g.method.join(F.broadcast(found), "class_name").select(F.lit("method").alias("kind"), "name", parameters().alias("params"), return_type().alias("type"))
    attributes = g.attribute.join(F.broadcast(found), "class_name").select(F.lit("attribute").alias("kind"), "name", F.array().cast("array<string>").alias("params"), F.col("type"))
    return methods.unionByName(attributes).orderBy("kind", "name")


def parameters() -> Column:
    """The detailed list where it has entries, else the plain one, else an empty one."""
    full, plain = F.col("params_detailed"), F.col("params_list")
    return F.when(F.size(full) > 0, full).when(F.size(plain) > 0, plain).otherwise(F.array().cast("array<string>"))


def return_type() -> Column:
    return F.coalesce(F.nullif("return_type", F.lit("")), F.lit("Any"))


def find_method(g: Graph, name: str, class_name: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Methods of a name, of a class if given; only without a class is the list cut."""
    held = g.method.filter(F.col("name") == name).join(g.class_.select(F.col("full_name").alias("class_name"), F.col("name").alias("class_short")).distinct(), "class_name")
    held = held.select("class_name", "class_short", "name", parameters().alias("params"), return_type().alias("type"))
    if class_name is not None:
        return held.filter(named("class_short", "class_name", class_name)).orderBy("class_name")
    return held.orderBy("class_name", "name").limit(limit)


def files_importing(g: Graph, target: str) -> DataFrame:
    wanted = g.file.filter(F.col("module_name").contains(target)).select(F.col("path").alias("dst_path"), F.col("module_name").alias("imported"))
    return g.imports.join(wanted, "dst_path").select(F.col("src_path").alias("file"), "imported").distinct()


def prefixes(name: Column, boundary: bool = False) -> Column:
    """All that a name begins with, itself included; with boundary, only whole dotted segments."""
    if boundary:
        parts = F.split(name, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, 1, i)))


def import_edges(imports: DataFrame, files: DataFrame, boundary: bool = False) -> DataFrame:
    """src_path, dst_path where an import names a module or a prefix of its name
    (with boundary, a prefix of whole segments).

    imports: path, module; an empty name imports nothing. Modules are spread
    over their prefixes, as many as a name has letters or segments, so all
    edges come from one equi-join.
    """
    mods = files.select(F.col("path").alias("dst_path"), F.explode(prefixes(F.col("module_name"), boundary)).alias("module"))
    want = imports.filter(F.col("module") != "").select(F.col("path").alias("src_path"), "module").distinct()
    return want.join(mods, "module").select("src_path", "dst_path").distinct()


def normalised(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("-"), F.lit("_"))


def module_matches(module: Column, name: str) -> Column:
    return (module == name) | module.startswith(name + ".") | (F.split_part(module, F.lit("."), F.lit(1)) == name)


def repository_for(g: Graph, module: str) -> DataFrame:
    """The repository with most files of the module; else one of like name, the closest first."""
    inside = g.file.filter(module_matches(F.col("module_name"), module)).groupBy("repo_name").agg(F.count(F.lit(1)).alias("n")).select("repo_name", F.lit(0).alias("tier"), (-F.col("n")).alias("order"))
    name = normalised(F.col("name"))
    want = module.lower().replace("-", "_")
    like = g.repository.filter(name.contains(want) | F.lit(want).contains(name)).select(F.col("name").alias("repo_name"), F.when(F.col("name") == module, 1).when(name == want, 2).otherwise(3).alias("tier"), F.lit(0).cast("bigint").alias("order"))
    return inside.unionByName(like).orderBy("tier", "order", "repo_name").limit(1).select("repo_name")


def repositories_for(g: Graph, modules: DataFrame) -> DataFrame:
    """module, repo_name: what repository_for finds, for every row of modules (module) at once.

    A name that holds another meets it on the rarest trigram of the shorter one.
    """
    wanted = modules.filter(F.col("module") != "").select("module").distinct()
    files = g.file.select("repo_name", "path", F.explode(F.array_distinct(prefixes(F.col("module_name"), True))).alias("module"))
    ranked = [F.lit(0).alias("tier"), F.col("repo_name")]
    inside = files.join(wanted, "module").groupBy("module", "repo_name").agg(F.count(F.lit(1)).alias("n")).select("module", *ranked, (-F.col("n")).alias("order"))
    rest = wanted.join(inside.select("module").distinct(), "module", "left_anti").withColumn("like", normalised(F.col("module")))
    names = g.repository.select(F.col("name").alias("repo_name"), normalised(F.col("name")).alias("like"))
    as_ = lambda df, name: df.withColumnRenamed("like", name)
    longer, shorter = containing(as_(rest, "long"), as_(names, "short")), containing(as_(names, "long"), as_(rest, "short"))
    tier = F.when(F.col("repo_name") == F.col("module"), 1).when(normalised(F.col("repo_name")) == normalised(F.col("module")), 2).otherwise(3)
    alike = longer.select("module", "repo_name").unionByName(shorter.select("module", "repo_name")).select("module", tier.alias("tier"), "repo_name", F.lit(0).cast("bigint").alias("order"))
    return inside.unionByName(alike).groupBy("module").agg(F.min_by("repo_name", F.struct("tier", "order", "repo_name")).alias("repo_name"))


def files_of_module(g: Graph, module: str, limit: int = 50) -> DataFrame:
    """Files of the best repository for the module: those of the module first, then its others."""
    best = F.broadcast(repository_for(g, module))
    files = g.file.join(best, "repo_name")
    return files.select("path", "module_name", module_matches(F.col("module_name"), module).alias("own")).orderBy(F.desc("own"), "path").limit(limit)


def module_contents(g: Graph, module: str) -> DataFrame:
    """Classes and functions of the module's repository."""
    best = F.broadcast(repository_for(g, module))
    held = g.class_.join(best, "repo_name").select(F.lit("class").alias("kind"), "name")
    return held.unionByName(g.function.join(best, "repo_name").select(F.lit("function").alias("kind"), "name")).distinct()


def similar_methods(g: Graph, class_name: str, method: str, limit: int = 5) -> DataFrame:
    """Methods of the class that hold the first three letters of a name."""
    held = g.method.join(g.class_.select(F.col("full_name").alias("class_name"), F.col("name").alias("short")).distinct(), "class_name")
    return held.filter(named("short", "class_name", class_name) & F.lower("name").contains(method[:3].lower())).select("name").distinct().orderBy("name").limit(limit)


def without_repository(g: Graph, repo: str) -> Graph:
    """The graph without a repository and all below it."""
    gone = g.class_.filter(F.col("repo_name") == repo).select(F.col("full_name").alias("class_name")).distinct()
    # A class that another repository defines too stays.
    gone = gone.join(g.class_.filter(F.col("repo_name") != repo).select(F.col("full_name").alias("class_name")).distinct(), "class_name", "left_anti")
    lost = g.file.filter(F.col("repo_name") == repo).select("path")
    keep = F.col("repo_name") != repo
    imports = g.imports
    if imports is not None:
        imports = imports.join(lost.withColumnRenamed("path", "src_path"), "src_path", "left_anti").join(lost.withColumnRenamed("path", "dst_path"), "dst_path", "left_anti")
    return Graph(
        g.repository.filter(F.col("name") != repo), g.file.filter(keep), g.class_.filter(keep), g.method.join(gone, "class_name", "left_anti"),
        g.attribute.join(gone, "class_name", "left_anti"), g.function.filter(keep), imports,
    )


def result_methods(g: Graph, repo: str = "pydantic_ai") -> DataFrame:
    """Methods of a repository's result-like classes."""
    held = g.class_.filter((F.col("repo_name") == repo) & F.col("name").rlike("Result|Stream|Run")).select(F.col("full_name").alias("class_name"))
    return g.method.join(held, "class_name").select("class_name", "name").distinct()


def limited(rows: DataFrame, n: int = LIMIT) -> DataFrame:
    """Whether a listing has come to its limit, and how many rows it has."""
    return rows.agg(F.count(F.lit(1)).alias("count")).select("count", (F.col("count") >= n).alias("limited"))


def run(g: Graph, command: str) -> DataFrame:
    """repos | explore <repo> | classes [repo] | class <name> | method <name> [class] | query <SQL over kg_ views>."""
    verb, _, rest = command.strip().partition(" ")
    args = rest.split()
    verb = verb.lower()
    if verb == "repos":
        return repos(g)
    if verb == "classes":
        return classes(g, args[0] if args else None)
    if verb == "explore" and args:
        return explore(g, args[0])
    if verb == "class" and args:
        return describe_class(g, args[0])
    if verb == "method" and args:
        return find_method(g, args[0], args[1] if len(args) > 1 else None)
    if verb == "query" and rest:
        for name in ("repository", "file", "class_", "method", "attribute", "function", "imports"):
            if (table := getattr(g, name)) is not None:
                table.createOrReplaceTempView(f"kg_{name.rstrip('_')}")
        return g.repository.sparkSession.sql(rest).limit(LIMIT)
    raise ValueError(f"no such command or too few arguments: {command!r}")
