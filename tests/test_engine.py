import datetime as dt

from pyspark.sql import functions as F

from strataweave.functions import json
from strataweave.operators import crawl, embedding, python_code, retrieval, store, throttling, validation
from strataweave.sources import files
from strataweave.streaming import incremental


def test_containment(spark):
    df = spark.createDataFrame([('{"a": {"b": 1}, "c": "x"}',), ('{"c": "y"}',), (None,)], "m string")
    count = lambda w: df.filter(json.contains(F.col("m"), w)).count()
    assert [count({}), count({"c": "x"}), count({"a": {"b": 1}}), count({"a": {"b": 2}})] == [3, 1, 1, 0]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("u", 0, "a"), ("u", 1, "b")], "url string, chunk_number int, content string")
    new = spark.createDataFrame([("u", 1, "c"), ("v", 0, "d")], "url string, chunk_number int, content string")
    once = store.upsert(old, new)
    rows = sorted(once.collect())
    assert [r["content"] for r in rows] == ["a", "c", "d"]
    assert sorted(store.upsert(once, new).collect()) == rows


def test_hybrid_covers_both_sides(spark):
    v = spark.createDataFrame([(1, "a", 0.9), (2, "b", -0.5)], "id bigint, content string, similarity double")
    w = spark.createDataFrame([(2, "b"), (3, "c")], "id bigint, content string")
    got = {r["id"]: (round(r["similarity"], 6), r["class"], r["content"]) for r in retrieval.hybrid(v, w).collect()}
    assert got == {1: (0.9, 1, "a"), 2: (-0.6, 0, "b"), 3: (0.5, 2, "c")}


def test_keyword_escape(spark):
    df = spark.createDataFrame([(1, "100%"), (2, "1000")], "id bigint, content string")
    assert df.filter(retrieval.has_keyword("100%")).count() == 2
    assert df.filter(retrieval.has_keyword("100%", escape=True)).count() == 1


def test_embedder_falls_back_to_zeros(spark):
    def load():
        def model(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("no")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    df = spark.createDataFrame([("good",), ("bad",), (None,)], "content string").coalesce(1)
    got = [list(r["embedding"]) for r in embedding.embed(df, embedding.ModelEmbedder(load, 2)).collect()]
    assert got == [[4.0, 1.0], [0.0, 0.0], [0.0, 1.0]]


def test_crawl_levels(spark):
    links = spark.createDataFrame([("a", "b#x"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a#top",)], "url string")
    got = {r["url"]: r["depth"] for r in crawl.crawl(links, start, 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    assert crawl.crawl(links, start, 0).count() == 0
    # b is redirected to B, whose links count; c fails, and so do its links; B is visited, b isn't.
    results = spark.createDataFrame([("a", "a", True), ("b", "B", True), ("c", "c", False), ("e", "e", True)], "url string, result_url string, ok boolean")
    more = links.unionByName(spark.createDataFrame([("B", "c"), ("B", "e"), ("e", "b"), ("e", "lost")], "src string, dst string"))
    got = sorted((r["url"], r["depth"]) for r in crawl.crawl(more, start, 6, results).collect())
    assert got == [("B", 1), ("a", 0), ("e", 2)]


def test_crawl_jobs_grow_with_depth_only(spark):
    """Levels are kept, so a level's plan holds no other level's."""
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)], "src string, dst string")
    got = {r["url"]: r["depth"] for r in crawl.crawl(chain, spark.createDataFrame([("n0",)], "url string"), 25).collect()}
    assert got == {f"n{i}": i for i in range(25)}


def test_sitemap(spark):
    good = '<urlset xmlns="x" xmlns:n="y"><url><loc> https://h/a?b=1&amp;c=2 </loc></url><n:loc>https://h/b</n:loc><loc/></urlset>'
    df = spark.createDataFrame([(good,), ("<urlset><loc>x</loc>",), (None,), ("<n:a><n:loc>unbound</n:loc></n:a>",)], "x string")
    assert [list(r[0]) for r in df.select(crawl.sitemap_links(F.col("x"))).collect()] == [["https://h/a?b=1&c=2", "https://h/b", ""], [], [], []]


def test_a_page_that_is_not_utf8(spark, tmp_path):
    (tmp_path / "bad.html").write_bytes(b"<p>caf\xe9 \xff ok</p>")
    (tmp_path / "good.html").write_text("<p>caf\u00e9</p>")
    got = {r["file_name"]: r["html"] for r in files.html_pages(spark, str(tmp_path)).collect()}
    assert got == {"bad.html": "<p>caf  ok</p>", "good.html": "<p>caf\u00e9</p>"}


SOURCE = '''
import os
from lib.core import Client as C
class A(Base):
    x: int = 1
    _y: int = 2
    def go(self, a, b: str = "q", *rest, flag, other=3, **more) -> bool: ...
    def _hidden(self): ...
def top(n): ...
'''
SCRIPT = '''
import lib
from lib.core import Client as C
c = C(1, key="v")
r = c.send("x")
c.name
with c.open() as f:
    f.read()
'''


def test_structure(spark):
    rows = python_code.structure(spark.createDataFrame([("a.py", SOURCE, "pkg.a"), ("b.py", "def (", "pkg.b")], "path string, source string, module string")).collect()
    by = {(r["kind"], r["name"]): r for r in rows if r["kind"] != "error"}
    assert set(by) == {("class", "A"), ("method", "go"), ("attribute", "x"), ("function", "top"), ("import", "os"), ("import", "lib.core")}
    assert list(by["method", "go"]["params_detailed"]) == ["a:Any", "b:str='q'", "[var_positional] *rest:Any", "[keyword_only] flag:Any", "[keyword_only] other:Any=3", "[var_keyword] **more:Dict[str, Any]"]
    assert [r["path"] for r in rows if r["kind"] == "error"] == ["b.py"]


def test_parameter_check_order(spark):
    check = lambda expected, n, kw: spark.range(1).select(validation.parameter_check(F.array(*map(F.lit, expected)).cast("array<string>"), F.lit(n), F.array(*map(F.lit, kw)).cast("array<string>")).alias("c")).first()["c"][:]
    assert check([], 1, []) == ("UNCERTAIN", 0.5)
    assert check(["a:int"], 2, []) == ("INVALID", 0.8)
    assert check(["a:int", "[var_positional] *r:Any"], 5, []) == ("VALID", 0.9)
    assert check(["a:int"], 0, ["a"]) == ("INVALID", 0.8)
    assert check(["a:int"], 1, ["z"]) == ("INVALID", 0.7)
    assert check(["a:int", "[keyword_only] k:int"], 1, []) == ("INVALID", 0.8)


def test_sources(spark, tmp_path):
    (tmp_path / "p.html").write_text("<html><head><title>t</title></head><body><h1>Head</h1><p>One <b>two</b>.</p><pre>x = 1</pre></body></html>")
    (tmp_path / "urls.json").write_text('{"urls": ["a", "b"]}')
    (tmp_path / "list.json").write_text('["c"]')
    repo = tmp_path / "repo"
    for name in ("pkg/a.py", "pkg/test_a.py", "tests/b.py", "setup.py", ".hidden/c.py"):
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_text("x = 1\n")
    page = files.with_markdown(files.html_pages(spark, str(tmp_path))).first()
    assert page["file_name"] == "p.html" and page["markdown"].startswith("# Head") and "**two**" in page["markdown"] and "```" in page["markdown"]
    assert [r[0] for r in files.url_list(spark, str(tmp_path / "urls.json")).collect()] == ["a", "b"]
    assert [r[0] for r in files.url_list(spark, str(tmp_path / "list.json")).collect()] == ["c"]
    assert [r["path"] for r in files.repository(spark, str(repo)).collect()] == ["pkg/a.py"]
    assert {r["kind"] for r in files.source_tree(spark, str(repo)).collect()} == {"python"}


def test_throttle_twins_agree(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [(i, 1, at + dt.timedelta(seconds=s), ok, 200 if ok else 429) for i, (s, ok) in enumerate([(0, True), (1, False), (2, False), (30, True), (61, False), (62, True)])]
    df = spark.createDataFrame(rows, "id bigint, client bigint, ts timestamp, ok boolean, status int")
    batch = throttling.error_streaks(throttling.sliding_counts(df, per_minute=3, burst=2)).orderBy("id").collect()
    df.drop("id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.drop("id").schema).parquet(str(tmp_path / "in"))
    q = incremental.throttle(stream, 3, 2).writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    live = spark.table("throttled").orderBy("ts").collect()
    assert [r["throttled"] for r in live] == [r["throttled"] for r in batch] == [False, False, True, True, False, False]
    assert [r["errors"] for r in live] == [r["errors"] for r in batch] == [0, 1, 2, 0, 1, 0]
    assert [r["backoff_s"] for r in live] == [r["backoff_s"] for r in batch]


def test_a_model_behind_another(spark, tmp_path):
    """A group of texts that one model fails on, however often it is asked, goes to the next."""

    def remote():
        def model(texts):
            raise OSError("no answer")

        return model

    def local():
        def model(texts):
            if len(texts) > 2:
                raise ValueError("two at a time")
            return [[float(len(t))] for t in texts]

        return model

    df = spark.createDataFrame([(t,) for t in ("a", "bb", "ccc", None, "eeeee")], "t string")
    got = df.select("t", embedding.ModelEmbedder(remote, 1, local, group=2, delays=(0.0,))(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == {"a": [1.0], "bb": [2.0], "ccc": [3.0], None: [0.0], "eeeee": [5.0]}
    assert embedding.scorer(["none"], {}) is None


def test_script_check(spark, tmp_path):
    good, other = tmp_path / "a.py", tmp_path / "b.txt"
    good.write_text("x = 1")
    other.write_text("x")
    assert files.script_check(spark, str(good)) == (True, None)
    assert [files.script_check(spark, p)[0] for p in (None, " ", str(tmp_path / "no.py"), str(other))] == [False] * 4
    assert "no such" in files.script_check(spark, str(tmp_path / "no.txt"))[1]
