"""Checks of script usage against the graph tables, confidence and reports.

Usage and graph meet in joins; verdicts are CASE expressions, so all scripts
are validated in one plan. Modules count as known per script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.text import percent

VALID, INVALID, UNCERTAIN, NOT_FOUND = "VALID", "INVALID", "UNCERTAIN", "NOT_FOUND"
# Words in the names of modules whose calls make objects.
CLASS_PATTERNS = ("Model", "Provider", "Client", "Agent", "Manager", "Handler", "Builder", "Factory", "Service", "Controller", "Processor")
# Modules that are never part of a project.
EXTERNAL = (
    "os", "sys", "json", "logging", "datetime", "pathlib", "typing", "collections", "asyncio", "subprocess", "ast", "re", "string", "urllib",
    "http", "email", "time", "uuid", "hashlib", "base64", "itertools", "functools", "operator", "contextlib", "copy", "pickle", "tempfile",
    "shutil", "glob", "fnmatch", "io", "codecs", "locale", "platform", "socket", "ssl", "threading", "queue", "multiprocessing", "concurrent",
    "warnings", "traceback", "inspect", "importlib", "pkgutil", "types", "weakref", "gc", "dataclasses", "enum", "abc", "numbers", "decimal",
    "fractions", "math", "cmath", "random", "statistics",
    "requests", "urllib3", "httpx", "aiohttp", "flask", "django", "fastapi", "pydantic", "sqlalchemy", "alembic", "psycopg2", "pymongo", "redis",
    "celery", "pytest", "unittest", "mock", "faker", "factory", "hypothesis", "numpy", "pandas", "matplotlib", "seaborn", "scipy", "sklearn",
    "torch", "tensorflow", "keras", "opencv", "pillow", "boto3", "botocore", "azure", "google", "openai", "anthropic", "langchain",
    "transformers", "huggingface_hub", "click", "typer", "rich", "colorama", "tqdm", "python-dotenv", "pyyaml", "toml", "configargparse",
    "marshmallow", "attrs", "dataclasses-json", "jsonschema", "cerberus", "voluptuous", "schema", "jinja2", "mako", "cryptography", "bcrypt",
    "passlib", "jwt", "authlib", "oauthlib",
)


def head(name: Column) -> Column:
    return F.split_part(name, F.lit("."), F.lit(1))


def own_import(name: Column) -> Column:
    """Whether an import is likely of the project itself, by its name; null where the project's modules decide."""
    top = head(name)
    odd = F.lower(top).rlike("test|mock|fake") | top.startswith("_") | (F.length(top) <= 2)
    return F.when(F.coalesce(name, F.lit("")) == "", False).when(name.startswith("."), True).when(top.isin(*EXTERNAL), False).when(~odd, True)


def is_internal_import(name: Column, project_modules: Column) -> Column:
    """Whether an import is likely of the project itself; project_modules is an array."""
    return F.coalesce(own_import(name), F.exists(project_modules, lambda m: name.startswith(m)), F.lit(False))


def is_class_call(name: Column, full_name: Column) -> Column:
    patterned = F.lit(False)
    for p in CLASS_PATTERNS:
        patterned |= F.coalesce(full_name.contains(p), F.lit(False))
    return F.coalesce(name.rlike(r"^\p{Lu}"), F.lit(False)) | patterned


def is_known(name: Column, modules: Column) -> Column:
    """A dotted name by its first segment, another as it is."""
    return F.coalesce(F.array_contains(modules, F.when(name.contains("."), head(name)).otherwise(name)), F.lit(False))


def is_known_to_reporter(name: Column, modules: Column) -> Column:
    """As is_known, but an undotted name also counts inside a module's name."""
    return F.coalesce(F.when(name.contains("."), F.array_contains(modules, head(name))).otherwise(F.exists(modules, lambda m: m.contains(name))), F.lit(False))


def parameter_check(expected: Column, n_args: Column, kwargs: Column) -> Column:
    """status and confidence of a call. expected: '[kind] name:type=default' strings."""
    trimmed = F.transform(expected, lambda p: F.trim(p))
    parsed = F.transform(
        trimmed,
        lambda p: F.struct(
            F.when(p.rlike(r"^\[[^\]]*\]"), F.regexp_extract(p, r"^\[([^\]]*)\]", 1)).otherwise("positional").alias("kind"),
            F.regexp_replace(p, r"^\[[^\]]*\]\s*", "").alias("text"),
        ),
    )
    varied = F.exists(parsed, lambda p: p["text"].rlike(r"^\*(?!\*)"))
    any_keyword = F.exists(parsed, lambda p: p["text"].startswith("**"))
    plain = F.filter(parsed, lambda p: ~p["text"].startswith("*") & p["text"].contains(":"))
    name = lambda p: F.split_part(p["text"], F.lit(":"), F.lit(1))
    optional = lambda p: p["text"].contains("=")
    only = lambda p: p["kind"] == "keyword_only"
    required = F.size(F.filter(plain, lambda p: ~only(p) & ~optional(p)))
    most = F.size(F.filter(plain, lambda p: ~only(p)))
    unknown = F.size(F.array_except(kwargs, F.transform(plain, name)))
    missing = F.size(F.array_except(F.transform(F.filter(plain, lambda p: only(p) & ~optional(p)), name), kwargs))
    verdict = lambda status, confidence: F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"))
    return (
        F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, verdict(UNCERTAIN, 0.5))
        .when(~varied & (n_args > most), verdict(INVALID, 0.8))
        .when(n_args < required, verdict(INVALID, 0.8))
        .when((unknown > 0) & ~any_keyword, verdict(INVALID, 0.7))
        .when(missing > 0, verdict(INVALID, 0.8))
        .otherwise(verdict(VALID, 0.9))
    )


def _verdict(status: Column, confidence: Column) -> Column:
    return F.struct(status.alias("status"), confidence.cast("double").alias("confidence"))


def check_imports(imports: DataFrame, graph_modules: DataFrame) -> DataFrame:
    """imports (script, module) with status; graph_modules: module_name."""
    tops = graph_modules.select(head(F.col("module_name")).alias("top")).distinct().withColumn("known", F.lit(True))
    met = imports.withColumn("top", head(F.col("module"))).join(tops, "top", "left")
    found = F.coalesce("known", F.lit(False))
    return met.select("script", "module", found.alias("in_graph"), F.when(found, VALID).otherwise(UNCERTAIN).alias("status"), F.when(found, 0.9).otherwise(0.8).alias("confidence"))


def known_modules(checked: DataFrame) -> DataFrame:
    return checked.filter("in_graph").groupBy("script").agg(F.array_sort(F.collect_set("module")).alias("modules"))


def module_of(name: Column) -> Column:
    """A dotted name without its last segment; empty for another."""
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise("")


def looked_up(uses: DataFrame, owner: str, members: DataFrame, repositories: DataFrame | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """uses with `params` and `found`: of the member whose owner has this full
    name, else this short one, else the last segment of this dotted name within
    the repository of the module before it (in any, without repositories).

    members: owner, params, the columns `on` and, with repositories, repo_name.
    repositories: module, repo_name. Of equal members the first in order counts.
    """
    short = F.substring_index("_full", ".", -1)
    repo = F.lit("") if repositories is None else F.col("repo_name")
    held = members.select(F.col("owner").alias("_full"), "params", *on, repo.alias("_repo")).withColumn("_short", short)
    first = lambda *order: F.min_by(F.struct("params"), F.struct(*order, F.to_json(F.struct("params"))))["params"]
    keyed = held.withColumn("_tier", F.lit(0)).withColumn("_owner", F.col("_full")).unionByName(held.withColumn("_tier", F.lit(1)).withColumn("_owner", F.col("_short")))
    direct = keyed.groupBy("_owner", *on).agg(first("_tier", "_full").alias("_params0"), F.lit(True).alias("_found0"))
    near = held.groupBy("_repo", "_short", *on).agg(first("_full").alias("_params1"), F.lit(True).alias("_found1"))
    met = uses.withColumn("_owner", F.col(owner)).join(direct, ["_owner", *on], "left")
    met = met.withColumn("_short", F.when(F.col("_owner").contains("."), F.substring_index("_owner", ".", -1)))
    if repositories is None:
        met = met.withColumn("_repo", F.lit(""))
    else:
        met = met.withColumn("_module", module_of(F.col("_owner"))).join(repositories.select(F.col("module").alias("_module"), F.col("repo_name").alias("_repo")), "_module", "left")
    met = met.join(near, ["_repo", "_short", *on], "left")
    kept = [c for c in uses.columns if c not in ("params", "found")]
    return met.select(*kept, F.when(F.col("_found0"), F.col("_params0")).otherwise(F.col("_params1")).alias("params"), F.coalesce("_found0", "_found1", F.lit(False)).alias("found"))


def _with_modules(uses: DataFrame, modules: DataFrame) -> DataFrame:
    return uses.join(modules, "script", "left").withColumn("modules", F.coalesce("modules", F.array().cast("array<string>")))


def _repo(df: DataFrame) -> list[str]:
    return [c for c in ("repo_name",) if c in df.columns]


def check_methods(calls: DataFrame, modules: DataFrame, methods: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """calls: script, line, object_type, name, n_args, kwargs; methods: class_name,
    name, params and, with repositories, repo_name. Classes are found as in looked_up()."""
    held = methods.select(F.col("class_name").alias("owner"), "name", "params", *_repo(methods))
    full = looked_up(_with_modules(calls, modules), "object_type", held, repositories, ("name",))
    found, check = F.col("found"), parameter_check(F.col("params"), F.col("n_args"), F.col("kwargs"))
    known = is_known(F.col("object_type"), F.col("modules"))
    status = F.when(F.col("object_type").isNull() | ~known, UNCERTAIN).when(~found, NOT_FOUND).when(check["status"] == INVALID, INVALID).otherwise(VALID)
    confidence = F.when(F.col("object_type").isNull(), 0.3).when(~known, 0.8).when(~found, 0.1).when(check["status"] == INVALID, check["confidence"]).otherwise(0.9)
    return full.select("script", "line", "object_type", "name", status.alias("status"), confidence.alias("confidence"))


def check_attributes(uses: DataFrame, modules: DataFrame, attributes: DataFrame, methods: DataFrame, repositories: DataFrame | None = None) -> DataFrame:
    """uses: script, line, object_type, name. A method used as an attribute counts as one."""
    pick = lambda df: df.select(F.col("class_name").alias("owner"), "name", F.lit(None).cast("array<string>").alias("params"), *_repo(df))
    held = pick(attributes).unionByName(pick(methods), allowMissingColumns=True).distinct()
    full = looked_up(_with_modules(uses, modules), "object_type", held, repositories, ("name",))
    known, found = is_known(F.col("object_type"), F.col("modules")), F.col("found")
    status = F.when(F.col("object_type").isNull() | ~known, UNCERTAIN).when(~found, NOT_FOUND).otherwise(VALID)
    confidence = F.when(F.col("object_type").isNull(), 0.3).when(~known, 0.8).when(~found, 0.2).otherwise(0.8)
    return full.select("script", "line", "object_type", "name", status.alias("status"), confidence.alias("confidence"))


def check_named(calls: DataFrame, modules: DataFrame, known: DataFrame, skip_without_name: bool, repositories: DataFrame | None = None) -> DataFrame:
    """Calls of classes or functions: script, line, full_name, name, n_args, kwargs.
    known: full_name, params and, with repositories, repo_name. Functions without a full name aren't skipped."""
    held = known.select(F.col("full_name").alias("owner"), "params", *_repo(known))
    full = looked_up(_with_modules(calls, modules).withColumn("_called", F.coalesce("full_name", "name")), "_called", held, repositories)
    outside = ~is_known(F.col("_called"), F.col("modules"))
    outside = outside if skip_without_name else F.col("full_name").isNotNull() & outside
    found, check = F.col("found"), parameter_check(F.col("params"), F.col("n_args"), F.col("kwargs"))
    status = F.when(outside, UNCERTAIN).when(~found, NOT_FOUND).when(check["status"] == INVALID, INVALID).otherwise(VALID)
    confidence = F.when(outside, 0.8).when(~found, 0.2).when(check["status"] == INVALID, check["confidence"]).otherwise(0.8)
    return full.select("script", "line", "full_name", "name", status.alias("status"), confidence.alias("confidence"))


def overall_confidence(validations: DataFrame) -> DataFrame:
    """Mean confidence over usages of known modules per script; 1 where there are none."""
    inside = F.when(F.col("in_graph"), F.col("confidence"))
    return validations.groupBy("script").agg(F.coalesce(F.avg(inside), F.lit(1.0)).alias("confidence"))


def hallucinations(methods: DataFrame, attributes: DataFrame) -> DataFrame:
    """script, type, line, name, object_type; a usage is reported once, as a method rather than an attribute."""
    cols = ["script", "line", "name", "object_type"]
    first = Window.partitionBy("script", "line", "name", "object_type").orderBy("confidence")
    once = lambda df: df.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1)
    missing = once(methods.filter(F.col("status") == NOT_FOUND)).select(*cols, F.lit("METHOD_NOT_FOUND").alias("type"))
    wrong = once(attributes.filter(F.col("status") == NOT_FOUND)).select(*cols, F.lit("ATTRIBUTE_NOT_FOUND").alias("type"))
    wrong = wrong.join(missing.select(*cols), cols, "left_anti")
    params = methods.filter(F.col("status") == INVALID).select(*cols, F.lit("INVALID_PARAMETERS").alias("type"))
    return missing.unionByName(wrong).unionByName(params)


def summary(validations: DataFrame) -> DataFrame:
    """Counts by status, and invalid and missing as a share of what could be judged."""
    n = lambda s: F.count_if(F.col("status") == s)
    counted = validations.groupBy("script").agg(F.count(F.lit(1)).alias("total"), n(VALID).alias("valid"), n(INVALID).alias("invalid"), n(UNCERTAIN).alias("uncertain"), n(NOT_FOUND).alias("not_found"))
    bad = F.col("invalid") + F.col("not_found")
    return counted.withColumn("hallucination_rate", bad / F.greatest(F.lit(1), F.col("valid") + bad))


def advice(methods: Column, attributes: Column, parameters: Column, confidence: Column) -> Column:
    """Lines of advice for numbers of missing methods and attributes and of calls that don't fit."""
    line = lambda test, *parts: F.when(test, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    text = lambda c: c.cast("string")
    lines = F.array(
        line(methods > 0, text(methods), " methods are not in the known libraries: look them up in the documentation."),
        line(attributes > 0, text(attributes), " attributes are not in the known classes: check their names."),
        line(parameters > 0, text(parameters), " calls have parameters that do not fit: check their signatures."),
        line((methods + attributes + parameters) == 0, "Nothing wrong was found in the known libraries."),
        line(confidence < 0.7, "Confidence is moderate: most usage is of libraries that are not known here."),
    )
    return F.filter(lines, lambda x: x.isNotNull())


def recommendations(found: DataFrame, confidence: DataFrame) -> DataFrame:
    """script and lines of advice. found: hallucinations; confidence: script, confidence."""
    n = lambda t: F.count_if(F.col("type") == t)
    counts = found.groupBy("script").agg(n("METHOD_NOT_FOUND").alias("m"), n("ATTRIBUTE_NOT_FOUND").alias("a"), n("INVALID_PARAMETERS").alias("p"))
    met = confidence.join(counts, "script", "left").na.fill(0)
    return met.select("script", advice(F.col("m"), F.col("a"), F.col("p"), F.col("confidence")).alias("recommendations"))


def libraries(usages: DataFrame) -> DataFrame:
    """Per module: how many usages of each kind, how many valid, and the names used."""
    return usages.groupBy("module").agg(F.count_if(F.col("kind") == "class").alias("classes"), F.count_if(F.col("kind") == "method").alias("methods"), F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("status") == VALID).alias("valid"), F.array_sort(F.collect_set("name")).alias("names"))


def verdict(kind: Column, owner: Column, full_name: Column, known: Column, found: Column, check: Column) -> Column:
    """status and confidence of a usage of any kind, as check_methods(), check_attributes() and check_named() have them."""
    member, invalid = kind.isin("method", "attribute"), (kind != "attribute") & (check["status"] == INVALID)
    outside = F.when(kind == "function", full_name.isNotNull() & ~known).otherwise(~known)
    untyped = member & owner.isNull()
    missing = F.when(kind == "method", 0.1).otherwise(0.2)
    return F.struct(
        F.when(untyped | outside, UNCERTAIN).when(~found, NOT_FOUND).when(invalid, INVALID).otherwise(VALID).alias("status"),
        F.when(untyped, 0.3).when(outside, 0.8).when(~found, missing).when(invalid, check["confidence"]).otherwise(F.when(kind == "method", 0.9).otherwise(0.8)).alias("confidence"),
    )


#: Items of a report, in the order in which they are sorted.
ITEM = ("seq", "line", "kind", "name", "of", "status", "confidence", "in_graph")


def by_script(usages: DataFrame, scripts: DataFrame) -> DataFrame:
    """A row per script (of usages: script and ITEM; scripts: script), by one shuffle of the usages: items
    (imports among them), counts, confidence, hallucinations, advice and libraries, all from the items' array."""
    item = F.struct(*ITEM)
    every = usages.select("script", item.alias("item")).unionByName(scripts.select("script", F.lit(None).cast(usages.select(item.alias("i")).schema["i"].dataType).alias("item")))
    rows = every.groupBy("script").agg(F.sort_array(F.collect_list("item")).alias("items"))  # nulls aren't listed
    of = lambda test: F.filter("used", test)
    n = lambda s: F.size(of(lambda x: x["status"] == s)).cast("bigint")
    known = of(lambda x: x["in_graph"])
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(known)
    said = lambda x, kind: F.struct(x["line"].alias("line"), F.lit(kind).alias("type"), x["name"].alias("name"), x["of"].alias("object_type"))
    found = lambda kind, status, name: F.transform(of(lambda x: (x["kind"] == kind) & (x["status"] == status)), lambda x: said(x, name))
    missing = F.array_distinct(found("method", NOT_FOUND, "METHOD_NOT_FOUND"))
    # A usage is reported once, as a method rather than an attribute.
    wrong = F.array_except(found("attribute", NOT_FOUND, "METHOD_NOT_FOUND"), missing)
    wrong = F.transform(wrong, lambda x: F.struct(x["line"].alias("line"), F.lit("ATTRIBUTE_NOT_FOUND").alias("type"), x["name"].alias("name"), x["object_type"].alias("object_type")))
    rows = rows.withColumn("used", F.filter("items", lambda x: x["kind"] != "import"))
    rows = rows.withColumns({
        "total": F.size("used").cast("bigint"), "valid": n(VALID), "invalid": n(INVALID), "uncertain": n(UNCERTAIN), "not_found": n(NOT_FOUND),
        "confidence": F.when(F.size(known) > 0, mean).otherwise(F.lit(1.0)), "hallucinations": F.concat(missing, wrong, found("method", INVALID, "INVALID_PARAMETERS")),
    })
    bad = F.col("invalid") + F.col("not_found")
    count = lambda kind: F.size(F.filter("hallucinations", lambda h: h["type"] == kind))
    modules = F.array_sort(F.array_distinct(F.transform(F.filter("items", lambda x: x["in_graph"]), lambda x: head(x["of"]))))
    names = lambda module, kind: F.array_distinct(F.transform(F.filter("items", lambda x: x["in_graph"] & (head(x["of"]) == module) & (x["kind"] == kind)), lambda x: F.struct(x["name"].alias("name"), x["status"].alias("status"), x["confidence"].alias("confidence"))))
    library = lambda m: F.struct(m.alias("module"), *(names(m, k).alias(p) for k, p in (("class", "classes"), ("method", "methods"), ("attribute", "attributes"), ("function", "functions"))))
    rows = rows.withColumn("hallucination_rate", bad / F.greatest(F.lit(1), F.col("valid") + bad)).withColumn("libraries", F.transform(modules, library))
    return rows.withColumn("recommendations", advice(count("METHOD_NOT_FOUND"), count("ATTRIBUTE_NOT_FOUND"), count("INVALID_PARAMETERS"), F.col("confidence"))).drop("used")


#: Valid items that a report as text lists; it counts the others.
LISTED = 10


def markdown(rows: DataFrame) -> DataFrame:
    """script and its report as text, from by_script()."""
    total = F.greatest(F.lit(1), F.col("total"))
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    counts = [text(f"- {c}: ", F.col(c).cast("string"), " (", percent(F.col(c) / total), ")") for c in ("valid", "invalid", "uncertain", "not_found")]
    title = lambda name: F.initcap(F.replace(F.lower(name), F.lit("_"), F.lit(" ")))
    line = lambda x: text("- line ", x["line"].cast("string"), ": ", x["kind"], " `", x["name"], "`", F.when(x["of"].isNull(), "").otherwise(text(" of `", x["of"], "`")), ", ", percent(x["confidence"]))
    known = lambda status: F.filter("items", lambda x: x["in_graph"] & (x["status"] == status))
    valid, more = known(VALID), F.size(known(VALID)) - LISTED
    either = lambda lines, none: F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(none)))
    uses = lambda lib, kind: F.transform(lib[kind], lambda u: text("  - ", F.lit(kind.removesuffix("es") if kind == "classes" else kind.removesuffix("s")), " `", u["name"], "`: ", F.lower(u["status"]), ", ", percent(u["confidence"])))
    libraries = F.flatten(F.transform("libraries", lambda lib: F.concat(F.array(text("- `", lib["module"], "`")), uses(lib, "classes"), uses(lib, "methods"), uses(lib, "attributes"), uses(lib, "functions"))))
    lines = F.concat(
        F.array(text("# ", F.col("script")), F.lit(""), text("Confidence: ", percent(F.col("confidence"))), F.lit(""), F.lit("## Summary"), text("- total: ", F.col("total").cast("string")), *counts, text("- hallucination rate: ", percent(F.col("hallucination_rate")))),
        F.array(F.lit(""), F.lit("## Findings")), either(F.transform("hallucinations", lambda h: text("- line ", h["line"].cast("string"), ": ", title(h["type"]), " `", h["name"], "`")), "- none"),
        F.array(F.lit(""), F.lit("## Libraries")), either(libraries, "- none"),
        F.array(F.lit(""), F.lit("## Not found")), either(F.transform(known(NOT_FOUND), line), "- none"),
        F.array(F.lit(""), F.lit("## Invalid")), either(F.transform(known(INVALID), line), "- none"),
        F.array(F.lit(""), F.lit("## Valid")), either(F.transform(F.slice(valid, 1, LISTED), line), "- none"), F.when(more > 0, F.array(text("- and ", more.cast("string"), " more"))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit(""), F.lit("## Advice")), F.transform("recommendations", lambda r: text("- ", r)),
    )
    return rows.select("script", text(F.array_join(lines, "\n"), "\n").alias("report"))
