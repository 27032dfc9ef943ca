import json

import pytest
from pyspark.sql import functions as F

from strataweave.operators import embedding as E
from strataweave.operators import store
from strataweave.plans import resumable, tools
from strataweave.plans.config import EngineConfig
from strataweave.plans.ingest import ingest

LIB = {
    "lib/__init__.py": "",
    "lib/core.py": "import os\nfrom lib.util import helper\nclass Client:\n    name: str = ''\n    def send(self, text: str, times=1) -> bool: ...\n    def open(self): ...\n",
    "lib/util.py": "def helper(a: int): ...\n",
    "tests/test_x.py": "x = 1\n",
}
GOOD = "from lib.core import Client\nc = Client()\nc.send('a', times=2)\nc.name\n"
BAD = "from lib.core import Client\nc = Client()\nc.sned('a')\nc.send()\nc.nmae\nother.thing()\n"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("checkout")
    for name, text in LIB.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return tools.parse_repository(spark, str(root), "lib")


def test_repository(graph):
    assert sorted(r["module_name"] for r in graph.file.collect()) == ["lib", "lib.core", "lib.util"]
    assert [r["full_name"] for r in graph.class_.collect()] == ["lib.core.Client"]
    row = tools.query_graph(graph, "explore lib").first()
    assert (row["files"], row["classes"], row["functions"], row["methods"], row["attributes"]) == (3, 1, 1, 2, 1)
    assert [r["name"] for r in tools.query_graph(graph, "REPOS").collect()] == ["lib"]
    assert tools.query_graph(graph, "query SELECT name FROM kg_method WHERE name LIKE 's%'").first()["name"] == "send"
    assert ("lib/core.py", "lib/util.py") in {tuple(r) for r in graph.imports.collect()}
    with pytest.raises(ValueError):
        tools.query_graph(graph, "method")


def test_scripts(spark, graph):
    scripts = spark.createDataFrame([("good.py", GOOD), ("bad.py", BAD), ("broken.py", "def (")], "path string, source string")
    got = tools.check_scripts(scripts, graph)
    found = sorted((r["script"], r["type"], r["name"]) for r in got["hallucinations"].collect())
    assert found == [("bad.py", "ATTRIBUTE_NOT_FOUND", "nmae"), ("bad.py", "INVALID_PARAMETERS", "send"), ("bad.py", "METHOD_NOT_FOUND", "sned")]
    confidence = {r["script"]: r["confidence"] for r in got["confidence"].collect()}
    assert confidence["good.py"] > confidence["bad.py"] and confidence["broken.py"] == 1.0
    advice = {r["script"]: r["recommendations"] for r in got["recommendations"].collect()}
    assert "Nothing wrong" in advice["good.py"][0] and len(advice["bad.py"]) >= 3
    report = json.loads(tools.reports(got).filter("script = 'bad.py'").first()["report"])
    assert len(report["hallucinations"]) == 3 and report["total"] == len(report["details"])


PAGES = [
    ("http://h/a", "<h1>Alpha</h1><p>alpha text here.</p><a href='/b'>b</a><a href=\"/b\">b</a>"),
    ("http://h/b", "<h1>Beta</h1><p>beta text here.</p><pre>" + "x = 1\n" * 40 + "</pre>"),
    ("http://h/c", "<p>never linked</p>"),
    ("http://h/sitemap.xml", "<urlset><url><loc>http://h/c</loc></url></urlset>"),
    ("http://h/t.txt", "plain text file"),
]


def test_crawl_and_search(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    config, embedder = EngineConfig(hybrid_search=True, agentic_rag=True, reranking=True, code_block_least=50), E.HashedWords(32)
    corpus = tools.smart_crawl(pages, "http://h/a", config, embedder)
    assert {r["url"] for r in corpus.chunks.collect()} == {"http://h/a", "http://h/b"}
    assert {r["url"] for r in tools.smart_crawl(pages, "http://h/sitemap.xml", config, embedder).chunks.collect()} == {"http://h/c"}
    assert tools.smart_crawl(pages, "http://h/t.txt", config, embedder).chunks.first()["content"] == "plain text file"
    assert tools.crawl_single_page(pages, "http://h/b", config, embedder).chunks.count() == 1
    best = tools.perform_rag_query(corpus, "beta text", config, embedder, k=2).first()
    assert best["url"] == "http://h/b" and best["rerank_score"] == 1.0
    assert tools.search_code_examples(corpus, "x", config, embedder).first()["url"] == "http://h/b"
    with pytest.raises(ValueError):
        tools.search_code_examples(corpus, "x", EngineConfig(), embedder)
    assert [r["source_id"] for r in tools.get_available_sources(corpus).collect()] == ["h"]
    tools.write_url_lists(pages.select("url"), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/urls").count() == len(PAGES)


def test_offline_pipeline(spark, tmp_path):
    saved = tmp_path / "saved"
    saved.mkdir()
    (saved / "p.html").write_text("<h1>Head</h1><p>Body text.</p>")
    index = spark.createDataFrame([('<a href="./p.html">p</a>',)], "html string")
    corpus = tools.offline_pipeline(spark, index, "https://h/docs/index.html", str(saved), str(tmp_path / "out"), EngineConfig(), E.HashedWords(8))
    assert corpus.chunks.count() == 1
    assert corpus.chunks.first()["content"].startswith("# Head") and corpus.sources.count() == 1
    assert tools.offline_pipeline(spark, index, "https://h/docs/index.html", str(saved), str(tmp_path / "out"), EngineConfig(), E.HashedWords(8), skip=("extract", "crawl")) is None


def tables(ingest_):
    c = ingest_.corpus()
    return [sorted(map(tuple, df.collect()), key=repr) for df in (c.chunks.select("id", "url", "chunk_number", "content", "source_id"), c.sources, c.code_examples.select("id", "url", "content"))]


def test_ingest_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    code = "\n\n```py\n" + "x = 1\n" * 200 + "```\n"
    first = [(f"http://h{i % 2}/{i}", f"Page {i}. " + "word " * 200 + code * (i % 2)) for i in range(6)]
    second = [(u, t if i % 3 else t + " more") for i, (u, t) in enumerate(first) if i != 5] + [("http://new/x", "New page.")]
    pages = lambda rows: spark.createDataFrame(rows, "url string, markdown string")
    make = lambda name: resumable.Ingest(spark, str(tmp_path / name), EngineConfig(agentic_rag=True, chunk_size=500), E.HashedWords(8))
    whole = make("whole")
    whole.run(pages(second))
    want = tables(whole)
    assert want[0] and want[1] and want[2]
    for stop in (1, 3):  # stopped after so many steps of the second run
        name = f"stopped{stop}"
        make(name).run(pages(first))
        steps = make(name).steps(pages(second))
        for _ in range(stop):
            next(steps)
        made = make(name).run()
        assert tables(make(name)) == want, stop
        assert (made["chunks"] > 0) == (stop < 2) and (made["sources"] > 0) == (stop < 3)
    assert set(make("stopped3").run(pages(second)).values()) == {0}  # the same pages again
    again = make("stopped3")
    with monkeypatch.context() as m:  # a step that fails leaves what was
        m.setattr(resumable, "source_table", lambda *_: pages(first).select(F.raise_error(F.lit("lost")).alias("x")))
        with pytest.raises(Exception, match="lost"):
            again.run(pages(first))
    assert tables(again)[1] == want[1]
    again.run()
    assert {r["url"] for r in again.corpus().chunks.collect()} == {u for u, _ in first}
    before = tables(again)
    again.tidy()
    assert tables(again) == before and len(again.chunks.versions()) == 1


def test_only_changed_pages_are_converted(spark, tmp_path):
    html = lambda rows: spark.createDataFrame(rows, "url string, html string")
    held = resumable.Ingest(spark, str(tmp_path / "i"), EngineConfig(), E.HashedWords(8))
    assert held.run(html([("a", "<p>A</p>"), ("b", "<p>B</p>"), (None, "x"), ("empty", None)]))["pages"] == 3
    assert held.run(html([("a", "<p>A</p>"), ("b", "<p>C</p>"), ("empty", None)])) == {"pages": 1, "chunks": 1, "sources": 1, "code_examples": 0}
    assert sorted((r["url"], r["content"]) for r in held.corpus().chunks.collect()) == [("a", "A"), ("b", "C")]
    assert held.run(html([("c", "<p>D</p>")]), part=True)["chunks"] == 1 and held.corpus().chunks.count() == 3


def test_ingest_flags(spark):
    pages = spark.createDataFrame([("http://h/a", "First sentence. " + "word " * 300)], "url string, markdown string")
    plain = ingest(pages, EngineConfig(chunk_size=500), E.HashedWords(8)).chunks
    rich = ingest(pages, EngineConfig(chunk_size=500, contextual_embeddings=True), E.HashedWords(8)).chunks
    assert plain.count() == rich.count() > 1
    assert all(r["content"] == r["raw_content"] for r in plain.collect())
    assert all(r["content"] == f"First sentence.\n---\n{r['raw_content']}" for r in rich.collect())
    assert EngineConfig.from_env({"USE_HYBRID_SEARCH": "True"}) == EngineConfig(hybrid_search=True)


def test_tables(spark):
    store.create_tables(spark, "strataweave_test")
    assert spark.table("strataweave_test.chunks").count() == 0
    store.truncate(spark, "strataweave_test.sources")
    spark.sql("DROP DATABASE strataweave_test CASCADE")
