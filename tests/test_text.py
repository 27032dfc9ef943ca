import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataweave.functions import text as T
from strataweave.functions import urls
from strataweave.plans import registry


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n`", max_size=400), st.integers(5, 60))
def test_chunks_keep_all_but_blanks(text, size):
    chunks = T.chunks_of(text, size)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert all(len(c) <= size for c in chunks)
    spans = list(T.cut_points(text, size))
    assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]]


def test_chunk_rules():
    assert T.chunks_of("", 10) == []
    assert T.chunks_of("   ", 10) == [""]
    fenced = "x" * 50 + "```" + "y" * 60
    assert T.chunks_of(fenced, 100)[0] == "x" * 50
    early_gap = "x" * 10 + "\n\n" + "y. " * 40
    assert len(early_gap[:100].strip()) == len(T.chunks_of(early_gap, 100)[0])
    sentence = "x" * 60 + ". " + "y" * 80
    assert T.chunks_of(sentence, 100)[0] == "x" * 60 + "."


def test_code_blocks():
    text = "intro\n```python\n" + "a = 1\n" * 10 + "```\nmiddle\n```\nplain words here\n```\ntail\n```"
    found = T.code_blocks_of(text, 5)
    assert [b["language"] for b in found] == ["python", ""]
    assert found[0]["context_before"] == "intro" and found[0]["code"].startswith("a = 1")
    assert found[1]["code"] == "plain words here"
    assert T.code_blocks_of(text, 1000) == []
    assert T.code_blocks_of("```\nfirst is skipped\n``` then ```\nkept\n```", 1)[0]["code"] == "then"


def test_columns(spark):
    df = spark.createDataFrame([("  a b \n",), ("# T\nx\n## U v\n",), ("",)], "t string")
    got = [r[0] for r in df.select(T.strip(F.col("t"))).collect()]
    assert got == ["a b", "# T\nx\n## U v", ""]
    assert [r[0] for r in df.select(T.headers(F.col("t"))).collect()] == ["", "# T; ## U v", ""]
    assert [r[0] for r in df.select(T.word_count(F.col("t"))).collect()] == [2, 6, 0]
    assert df.select(T.rfind(F.lit("a.b.c"), ".")).first()[0] == 3
    assert df.select(T.rfind(F.lit("abc"), ".")).first()[0] == -1
    assert df.select(T.title(F.lit("METHOD_NOT_FOUND")), T.percent(F.lit(0.123))).first()[:] == ("Method Not Found", "12.3%")


def test_urls(spark):
    df = spark.createDataFrame([("https://u:p@h.org:80/a/b.html?x#y",), ("no/scheme.txt",), ("https://h.org/sitemap/x",)], "u string")
    u = F.col("u")
    assert [r[0] for r in df.select(urls.source_id(u)).collect()] == ["u:p@h.org:80", "no/scheme.txt", "h.org"]
    assert [r[0] for r in df.select(urls.crawl_type(u)).collect()] == ["webpage", "text_file", "sitemap"]
    assert df.select(urls.original_url(F.lit("docs_a.html"), "docs_", "https://h.org/docs/")).first()[0] == "https://h.org/docs/a.html"
    assert df.select(urls.original_url(F.lit("b.html"), "docs_", "https://h.org/docs/")).first()[0] == "local://b"
    assert df.select(urls.blob_url(F.lit("/src/a.py"), "/src", "https://h.org/r", "abc")).first()[0] == "https://h.org/r/blob/abc/a.py"
    assert df.select(urls.blob_url(F.lit("/x/a.py"), "/src", "https://h.org/r", "abc")).first()[0] == "file:///x/a.py"


def device_metadata_of(text):
    every = lambda word: sorted(set(re.findall(rf"{word}\s+(\w+)", text)))
    name = re.search(r"device\s+(\w+)", text)
    return name and name[1], every("is"), every("implement"), every("group"), every("method")


def test_device_metadata_reads_names_in_any_script(spark):
    texts = ["device größe is überwacht implement 信号 group é1 method naïve", "device\u00a0x is\u2003y", "device émetteur", "no such word", ""]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.device_metadata(F.col("t")).alias("m")).collect()
    assert found[0]["m"]["device_name"] == "größe"
    for r in found:
        m = r["m"]
        assert (m["device_name"], *(m[n] for n in ("templates", "interfaces", "register_groups", "methods"))) == device_metadata_of(r["t"])


def test_device_metadata_of_all_documents(spark):
    d = "/root/testdata/sf0.001"
    end = " device größe is überwacht is plain implement io method naïve"
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        name, *lists = device_metadata_of(r["text"] + end)
        want[r["doc_id"]] = (name, *map(",".join, lists))
    got = registry.QUERIES["str_11_device_metadata"](spark, d).collect()
    assert {r["doc_id"]: (r["device_name"], r["templates"], r["interfaces"], r["register_groups"], r["methods"]) for r in got} == want


def test_white_space_of_any_script(spark):
    texts = ["\u00a0a\u00a0b\u2003", "\x1cx\x85y\u3000", "\u200bz", "café  naïve", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.strip(F.col("t")).alias("s"), T.word_count(F.col("t")).alias("n")).collect()
    assert [(r["s"], r["n"]) for r in got] == [(t.strip(), len(t.split())) for t in texts]
    meta = spark.createDataFrame([("class Größe: pass\ndef naïve(): pass\nimport device.é\n",)], "t string").select(T.python_metadata(F.col("t")).alias("m")).first()["m"]
    assert (meta["classes"], meta["functions"], meta["library_imports"]) == (["Größe"], ["naïve"], ["device.é"])
