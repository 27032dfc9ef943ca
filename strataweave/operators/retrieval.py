"""Vector, keyword, hybrid and multi-source retrieval over chunk tables.

A table of chunks has id, url, chunk_number, content, metadata (JSON text),
source_id and embedding; code examples have summary too. Every search is one
plan: multi-source search is a window over sources, not a loop.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions import json
from strataweave.functions.vectors import similarity_to

BOOST = 1.2
KEYWORD_SIMILARITY = 0.5


def filtered(chunks: DataFrame, metadata: Mapping | None = None, source: str | None = None) -> DataFrame:
    if metadata:
        chunks = chunks.filter(json.contains(F.col("metadata"), metadata))
    return chunks if source is None else chunks.filter(F.col("source_id") == source)


def match(chunks: DataFrame, query: Sequence[float], k: int = 10, metadata: Mapping | None = None, source: str | None = None) -> DataFrame:
    """The k chunks nearest by cosine, with their similarity; vectors missing or zero come last."""
    scored = filtered(chunks, metadata, source).withColumn("similarity", similarity_to(F.col("embedding"), list(query)))
    return scored.drop("embedding").orderBy(F.desc_nulls_last("similarity"), "id").limit(k)


def has_keyword(query: str, columns: Sequence[str] = ("content",), escape: bool = False) -> Column:
    """ILIKE on any of the columns; % and _ in the query are wildcards unless escaped."""
    if escape:
        for mark in "\\%_":
            query = query.replace(mark, "\\" + mark)
    found = F.lit(False)
    for c in columns:
        found |= F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return found


def keyword(chunks: DataFrame, query: str, k: int = 10, source: str | None = None, columns: Sequence[str] = ("content",), escape: bool = False) -> DataFrame:
    return filtered(chunks, None, source).filter(has_keyword(query, columns, escape)).drop("embedding").orderBy("id").limit(k)


def hybrid(vector: DataFrame, words: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """Vector and keyword results in one list: found by both (similarity times
    1.2, at most 1), by vector only, by keyword only (0.5); class is 0, 1 or 2."""
    on = ["id", *partition]
    v = vector.withColumn("_v", F.lit(True))
    w = words.select(*on, *(F.col(c).alias(f"_w_{c}") for c in words.columns if c not in on), F.lit(True).alias("_w"))
    met = v.join(w, on, "full_outer")
    kind = F.when(F.col("_v") & F.col("_w"), 0).when(F.col("_v"), 1).otherwise(2)
    score = F.when(F.col("_v") & F.col("_w"), F.least(F.lit(1.0), F.col("similarity") * BOOST)).when(F.col("_v"), F.col("similarity")).otherwise(F.lit(KEYWORD_SIMILARITY))
    rest = [F.coalesce(F.col(c), F.col(f"_w_{c}")).alias(c) for c in words.columns if c not in on]
    return met.select(*on, *rest, score.alias("similarity"), kind.alias("class"))


def ranked(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc_nulls_last("similarity"), "class", "id")


def multi_source(chunks: DataFrame, query: Sequence[float], sources: Sequence[str], k: int = 10, words: str | None = None, columns: Sequence[str] = ("content",)) -> DataFrame:
    """Up to k vector results (and k keyword results) of each source, then the best k of all."""
    inside = chunks.filter(F.col("source_id").isin(*sources))
    scored = inside.withColumn("similarity", similarity_to(F.col("embedding"), list(query))).drop("embedding")
    best = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("similarity"), "id")
    vector = scored.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")
    if words is None:
        return ranked(vector.withColumn("class", F.lit(1))).limit(k)
    first = Window.partitionBy("source_id").orderBy("id")
    held = inside.drop("embedding").filter(has_keyword(words, columns)).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n")
    return ranked(hybrid(vector, held, ["source_id"])).limit(k)


def search(chunks: DataFrame, query: Sequence[float], words: str, k: int = 5, source: str | None = None, use_hybrid: bool = True) -> DataFrame:
    """Documents for a question. Hybrid results of one source list are not cut to k."""
    if not use_hybrid:
        return match(chunks, query, k, source=source)
    return ranked(hybrid(match(chunks, query, 2 * k, source=source), keyword(chunks, words, 2 * k, source)))


def search_code(examples: DataFrame, query: Sequence[float], words: str, k: int = 5, source: str | None = None) -> DataFrame:
    """Code examples: those found both ways first, then by vector, then by keyword, k in all."""
    vector = match(examples, query, 2 * k, source=source)
    order = Window.orderBy(F.desc_nulls_last("similarity"), "id")
    vector = vector.withColumn("_rank", F.row_number().over(order))  # of 2k rows
    held = keyword(examples, words, 2 * k, source, ("content", "summary"))
    both = hybrid(vector.drop("_rank"), held).join(vector.select("id", "_rank"), "id", "left")
    return both.orderBy("class", F.coalesce("_rank", F.lit(1 << 30)), "id").limit(k).drop("_rank")


def rerank(results: DataFrame, query: str, scorer: Callable[[Column, Column], Column], text: str = "content") -> DataFrame:
    """Results by the scorer of (query, text) pairs, with rerank_score."""
    return results.withColumn("rerank_score", scorer(F.lit(query), F.col(text))).orderBy(F.desc("rerank_score"), "id")


def sources_for(kind: str, family: str = "device") -> tuple[list[str] | None, list[str]]:
    """(sources to search, sources to leave out) for a kind of question."""
    dml, python = f"{family}-dml", f"{family}-python"
    return {"dml": ([dml], []), "python": ([python], []), "source": ([dml, python], []), "docs": (None, [dml, python])}.get(kind, (None, []))


def envelope(results: DataFrame, **fields: str) -> DataFrame:
    """One row of JSON: success, the given fields, results, count. For lists of k rows."""
    listed = F.sort_array(F.collect_list(F.struct(*results.columns)))
    return results.agg(F.to_json(F.struct(F.lit(True).alias("success"), *(F.lit(v).alias(n) for n, v in fields.items()), listed.alias("results"), F.count(F.lit(1)).alias("count"))).alias("answer"))
