"""Text functions: chunking, section facts, code blocks, prompts, source metadata."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE = "```"
AT_ONCE = 500
#: White space in any script, as Python has it; Java's own class is ASCII.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
INK = r"[^\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """Without white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def rfind(text: Column, part: str) -> Column:
    """Place of the last occurrence, from 0, or -1."""
    at = F.instr(F.reverse(text), part[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.char_length(text) - at - (len(part) - 1))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""))


def cut_points(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Spans of chunks of at most `size` characters.

    A span ends before its last code fence, else its last blank line, else
    after its last sentence, provided that lies beyond 30 % of the size. A
    blank line or sentence that comes earlier makes a hard cut instead.
    """
    at, least = 0, 0.3 * size
    while at < len(text):
        if at + size >= len(text):
            yield at, len(text)
            return
        piece = text[at : at + size]
        end = size
        if (fence := piece.rfind(FENCE)) > least:
            end = fence
        elif (gap := piece.rfind("\n\n")) >= 0:
            end = gap if gap > least else size
        elif (stop := piece.rfind(". ")) > least:
            end = stop + 1
        yield at, at + end
        at += end


def chunks_of(text: str, size: int = 5000) -> list[str]:
    """Stripped chunks; empty ones are dropped, but for the last."""
    spans = list(cut_points(text, size))
    found = [text[a:b].strip() for a, b in spans]
    return [c for i, c in enumerate(found) if c or i == len(found) - 1]


def chunk(docs: DataFrame, text: str = "text", size: int = 5000) -> DataFrame:
    """docs without `text`, one row per chunk: chunk_number (from 0), content. Null text has none."""
    keep = [c for c in docs.columns if c != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker holds the chunks of some documents, not those of a whole batch.
        for batch in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, whole.num_rows, AT_ONCE)):
            rows, numbers, contents = [], [], []
            for row, value in enumerate(batch.column(text)):
                for number, content in enumerate(chunks_of(value.as_py() or "", size)):
                    rows.append(row)
                    numbers.append(number)
                    contents.append(content)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(numbers, pa.int32()), pa.array(contents, pa.string())], names=[*keep, "chunk_number", "content"])

    return docs.mapInArrow(run, f"{fields}, chunk_number int, content string")


def headers(text: Column) -> Column:
    """Markdown headings, as '<marks> <heading>' joined by '; '."""
    found = lambda g: F.regexp_extract_all(text, F.lit(rf"(?m)^(#+){SPACE}+(.+)$"), F.lit(g))
    return F.array_join(F.zip_with(found(1), found(2), lambda marks, title: F.concat_ws(" ", marks, title)), "; ")


def with_section_info(chunks: DataFrame, text: str = "content") -> DataFrame:
    return chunks.withColumns({"headers": headers(F.col(text)), "char_count": F.char_length(text), "word_count": word_count(F.col(text))})


def code_blocks_of(text: str, least: int = 1000) -> list[dict]:
    """Fenced blocks of at least `least` characters, with 1000 characters of context on either side."""
    at = 3 if text.strip().startswith(FENCE) else 0
    places = []
    while (at := text.find(FENCE, at)) >= 0:
        places.append(at)
        at += 3
    found = []
    for a, b in zip(places[::2], places[1::2], strict=False):
        body, language = text[a + 3 : b], ""
        first, newline, rest = body.partition("\n")
        if newline and (name := first.strip()) and " " not in name and len(name) < 20:
            language, code = name, rest.strip()
        else:
            code = (rest if newline and not first.strip() else body).strip()
        if len(code) >= least:
            before, after = text[max(0, a - 1000) : a].strip(), text[b + 3 : b + 1003].strip()
            found.append({"code": code, "language": language, "context_before": before, "context_after": after, "full_context": f"{before}\n\n{code}\n\n{after}"})
    return found


def code_blocks(docs: DataFrame, text: str = "text", least: int = 1000) -> DataFrame:
    """docs without `text`, one row per block: block (from 0), code, language, contexts."""
    keep = [c for c in docs.columns if c != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    parts = ["code", "language", "context_before", "context_after", "full_context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, blocks = [], [], []
            for row, value in enumerate(batch.column(text)):
                for number, block in enumerate(code_blocks_of(value.as_py() or "", least)):
                    rows.append(row)
                    numbers.append(number)
                    blocks.append(block)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(numbers, pa.int32()), *(pa.array([b[p] for b in blocks], pa.string()) for p in parts)], names=[*keep, "block", *parts])

    return docs.mapInArrow(run, f"{fields}, block int, " + ", ".join(f"{p} string" for p in parts))


def context_prompt(document: Column, piece: Column) -> Column:
    return F.concat(F.lit("<document>\n"), F.substring(document, 1, 25000), F.lit("\n</document>\n<chunk>\n"), piece, F.lit("\n</chunk>\nSay in a sentence or two where this chunk stands in the document."))


def contextual_text(context: Column, piece: Column) -> Column:
    return F.concat(context, F.lit("\n---\n"), piece)


def code_summary_prompt(code: Column, before: Column, after: Column) -> Column:
    return F.concat(F.lit("Context before:\n"), F.right(before, F.lit(500)), F.lit("\n\nCode:\n"), F.substring(code, 1, 1500), F.lit("\n\nContext after:\n"), F.substring(after, 1, 500), F.lit("\n\nSay in a sentence or two what this code shows."))


def code_embedding_text(code: Column, summary: Column) -> Column:
    return F.concat(code, F.lit("\n\nSummary: "), summary)


def code_query(query: Column) -> Column:
    """The query, worded like the text that code examples are embedded by."""
    return F.concat(F.lit("Code example for "), query, F.lit("\n\nSummary: Example code showing "), query)


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


#: White space and a name, in any script, as in Python.
THEN_NAME = f"{SPACE}+({WORD}+)"


def device_metadata(text: Column) -> Column:
    """Device name, templates, interfaces, register groups and methods of device-modelling source."""
    every = lambda word: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(word + THEN_NAME), F.lit(1))))
    return F.struct(
        F.nullif(F.regexp_extract(text, "device" + THEN_NAME, 1), F.lit("")).alias("device_name"), every("is").alias("templates"), every("implement").alias("interfaces"),
        every("group").alias("register_groups"), every("method").alias("methods"), line_count(text).alias("line_count"), F.char_length(text).alias("char_count"),
    )


def python_metadata(text: Column, library: str = "device") -> Column:
    """Classes, functions and imports of a library in Python source, by pattern."""
    every = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))
    return F.struct(
        every("class" + THEN_NAME).alias("classes"), every("def" + THEN_NAME).alias("functions"),
        F.array_sort(F.array_union(every(f"import{SPACE}+({library}{INK}*)"), every(f"from{SPACE}+({library}{INK}*)"))).alias("library_imports"),
        line_count(text).alias("line_count"), F.char_length(text).alias("char_count"),
    )


def source_of_kind(kind: Column, family: str = "device") -> Column:
    return F.when(kind == "dml", f"{family}-dml").when(kind == "python", f"{family}-python").otherwise(f"{family}-source")


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))


def hundredths(number: Column, digits: int = 1) -> Column:
    """A number of hundredths as text, of its exact binary value: large ones with all their digits, and nan and inf."""

    @F.pandas_udf("string")
    def written(numbers: pd.Series) -> pd.Series:
        return numbers.map(lambda x: f"{x:,.{digits}f}%")

    return F.when(number.isNotNull(), written(number))


def title(name: Column) -> Column:
    return F.initcap(F.lower(F.replace(name, F.lit("_"), F.lit(" "))))


def error_kind(message: Column) -> Column:
    """auth, connect, database or other, by the first of these kinds whose words a message holds."""
    low = F.lower(message)
    has = lambda *words: F.coalesce(low.rlike("|".join(words)), F.lit(False))
    return F.when(has("authentication", "unauthorized"), "auth").when(has("connection", "refused", "timeout"), "connect").when(has("database"), "database").otherwise("other")


def word_estimate(text: Column) -> Column:
    """About how many words a text has: a quarter of its characters."""
    return F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4)


def chat_content(answer: Column) -> Column:
    """The text of a chat completion's first choice, stripped; null where there is none."""
    return strip(F.get_json_object(answer, "$.choices[0].message.content"))


def progress(done: Column, total: Column, elapsed_s: Column) -> Column:
    """percent, per_second and eta_s of a run that has done so many of so many; nulls before the first."""
    rate = F.try_divide(done, elapsed_s)
    return F.struct(F.try_divide(done * 100.0, total).alias("percent"), rate.alias("per_second"), F.try_divide(total - done, rate).alias("eta_s"))
