"""Indexes, the chunk store, streams into it, and the limiter that waits, against plain versions."""

import datetime as dt
import json as standard
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.functions import json
from strataweave.operators import metadata_index, text_index, vector_index
from strataweave.operators.chunk_store import ChunkStore, Conflict
from strataweave.operators.retrieval import has_keyword, match
from strataweave.streaming import incremental, limiter

# --- vector index --------------------------------------------------------------------

CHUNK = "id bigint, content string, metadata string, source_id string, embedding array<double>"


def clustered(n, groups, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (groups, 12))
    return centres[np.arange(n) % groups] + rng.normal(0, 0.05, (n, 12))


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, f"text {i}", '{"kind": "a"}' if i % 2 else '{"kind": "b"}', f"s{i % 5}", [float(x) for x in v]) for i, v in enumerate(clustered(600, 12, 1))]
    rows += [(1000, "none", "{}", "s1", None), (1001, "zero", "{}", "s1", [0.0] * 12), (1002, "short", "{}", "s1", [1.0]), (1003, "nan", "{}", "s1", [float("nan")] * 12)]
    return spark.createDataFrame(rows, CHUNK).cache()


@pytest.fixture(scope="module")
def index(chunks, tmp_path_factory):
    made = vector_index.build(chunks.filter("id < 300 OR id >= 1000"), str(tmp_path_factory.mktemp("vectors") / "index"), lists=12)
    made.add(chunks.filter("id >= 300 AND id < 1000"))
    return made


def listed(df):
    return [(r["id"], round(r["similarity"], 9) if r["similarity"] is not None and r["similarity"] == r["similarity"] else None) for r in df.collect()]


@pytest.mark.parametrize("k", [1, 10, 700])
def test_index_gives_what_a_scan_gives(chunks, index, k):
    for at in (0, 5, 400):
        query = clustered(600, 12, 1)[at].tolist()
        plain = chunks.filter("id <> 1003")
        assert listed(index.match(query, k).filter("id <> 1003"))[: k - 1] == listed(match(plain, query, k))[: k - 1]
        assert listed(index.match(query, k, {"kind": "a"}, "s2")) == listed(match(plain, query, k, {"kind": "a"}, "s2"))
    assert listed(index.match([1.0, 2.0], 3)) == listed(match(chunks, [1.0, 2.0], 3))  # of another length


def test_lists_that_can_not_answer_are_not_read(index):
    query = clustered(600, 12, 1)[7].tolist()
    plan = index.match(query, 5)._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    wanted = filters.partition("PartitionFilters: [")[2].partition("]")[0]
    assert "list#" in wanted and wanted.count(",") < 4  # a few of twelve lists


def test_recall_of_a_few_lists(chunks, index):
    hits = total = 0
    for at in range(0, 600, 40):
        query = clustered(600, 12, 1)[at].tolist()
        want = {i for i, _ in listed(match(chunks.filter("id < 1000"), query, 10))}
        hits += len(want & {i for i, _ in listed(index.match(query, 10, probes=2))})
        total += len(want)
    assert hits >= 0.9 * total


def test_many_questions(spark, chunks, index):
    asked = chunks.filter("id % 50 = 0 OR id > 1000").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    got = sorted((r["query_id"], r["id"]) for r in index.match_all(asked, 4).collect())
    vectors = {r["id"]: r["embedding"] for r in chunks.filter("id < 1000").collect()}
    want = []
    for q in range(0, 600, 50):
        score = lambda i: -np.dot(vectors[i], vectors[q]) / np.linalg.norm(vectors[i])  # noqa: B023, E731
        want += [(q, i) for i in sorted(vectors, key=lambda i: (score(i), i))[:4]]
    assert got == sorted(want)


def test_index_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([(1, "x", "{}", "s", None)], CHUNK)
    index = vector_index.build(empty, str(tmp_path / "v"), lists=4)
    assert listed(index.match([1.0, 0.0], 3)) == [(1, None)]
    assert index.match([1.0], 3, probes=2).count() == 1


# --- metadata index ------------------------------------------------------------------------


def test_metadata_index_finds_what_the_filter_finds(spark, tmp_path):
    rng = random.Random(1)
    value = lambda: rng.choice(["x", "y", "1", 1, 2.5, True, None, "a b", "ü"])
    rows = [(i, standard.dumps({k: value() if rng.random() < 0.7 else {"in": value(), "deep": {"er": value()}} for k in rng.sample("abc", rng.randint(0, 3))})) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "not json"), (503, "[1]"), (504, '"a"'), (505, '{"a": "x", "a": "y"}')]
    df = spark.createDataFrame(rows, "id bigint, metadata string")
    index = metadata_index.build(df, str(tmp_path / "p"), buckets=8)
    for wanted in ({"a": "x"}, {"a": 1}, {"a": "1"}, {"a": {"in": "y"}}, {"a": {"deep": {"er": 2.5}}, "b": "x"}, {"c": True}, {"b": "ü", "a": {"in": "a b"}}, {"zz": 1}, {}, {"a": {}}):
        want = sorted(r["id"] for r in df.filter(json.contains(F.col("metadata"), wanted)).collect())
        assert sorted(r["id"] for r in index.find(df, wanted).collect()) == want, wanted
    assert sorted(r["id"] for r in index.find(df, {"a": "x"}).collect()) == sorted(i for i, m in rows[:400] if standard.loads(m).get("a") == "x") + ([505] if df.filter("id = 505").filter(json.contains(F.col("metadata"), {"a": "x"})).count() else [])


def test_metadata_index_is_kept_up(spark, tmp_path):
    old = spark.createDataFrame([(1, '{"a": "x"}'), (2, '{"a": "x"}')], "id bigint, metadata string")
    index = metadata_index.build(old, str(tmp_path / "p"))
    new = spark.createDataFrame([(1, '{"a": "y"}'), (2, '{"a": "x"}'), (3, '{"a": "y"}')], "id bigint, metadata string")
    index.add(new.filter("id <> 2"))
    ids = lambda ix, w: sorted(r["id"] for r in ix.find(new, w).collect())
    assert ids(index, {"a": "y"}) == [1, 3] and ids(index, {"a": "x"}) == [2]  # 1's old posting is stale
    assert sorted(r["id"] for r in index.candidates({"a": "x"}).collect()) == [1, 2]
    tight = index.compact(new, str(tmp_path / "q"))
    assert [r["id"] for r in tight.candidates({"a": "x"}).collect()] == [2] and ids(tight, {"a": "y"}) == [1, 3]


def test_metadata_is_parsed_for_candidates_only(spark, tmp_path):
    df = spark.createDataFrame([(i, '{"a": "%d"}' % (i % 10)) for i in range(100)], "id bigint, metadata string")
    df.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    index = metadata_index.build(rows, str(tmp_path / "p"))
    plan = index.find(rows, {"a": "3"})._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert "get_json_object" in plan[:join] or "get_json_object" in plan.splitlines()[[i for i, x in enumerate(plan.splitlines()) if "Join" in x][0]]
    assert "get_json_object" not in "\n".join(plan.splitlines()[[i for i, x in enumerate(plan.splitlines()) if "Join" in x][0] + 1 :])
    scans = index.candidates({"a": "3"})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scans or "PartitionFilters: [bucket" in scans


# --- substrings ---------------------------------------------------------------------------------


def test_text_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcAB %_é") for _ in range(rng.randint(0, 30))), None if i % 7 == 0 else "ab c") for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None, None)], "id bigint, content string, summary string")
    index = text_index.build(df, str(tmp_path / "t"), ("content", "summary"), buckets=8)
    for query in ("abc", "ABCA", "a%b", "ab_ab", "b c", "é a", "abcabcabcabc", "a", "", "bc%ab"):
        want = sorted(r["id"] for r in df.filter(has_keyword(query, ("content", "summary"))).collect())
        assert sorted(r["id"] for r in index.find(df, query).collect()) == want, query
    assert index.candidates(text_index.wanted("abcab")).count() < 40


def test_text_index_lists_are_small_and_texts_not_shuffled(spark, tmp_path):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(2000)]
    df = spark.createDataFrame([(i * 10**9, t) for i, t in enumerate(texts)], "id bigint, content string").coalesce(2)
    index = text_index.build(df, str(tmp_path / "t"))
    postings = sum(len({t[i : i + 3] for i in range(len(t) - 2)}) for t in texts)
    assert sum(f.stat().st_size for f in (tmp_path / "t").rglob("*.parquet")) < postings
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.find(df, words[0][:5])
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        assert not re.search(r"\) Exchange.*\nInput.*content", plan) and "Exchange" in plan
        assert sorted(r["id"] for r in found.collect()) == [i * 10**9 for i, t in enumerate(texts) if words[0][:5] in t]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_text_index_over_blocks_loads_and_kinds_of_ids(spark, tmp_path):
    # More rows in a task than a block has, and ids that are texts or null.
    rows = spark.range(70_000).select(F.when(F.col("id") != 5, F.concat(F.lit("r"), F.col("id").cast("string"))).alias("key"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("N"), "id", F.lit(" é😀x"))).alias("t"))
    index = text_index.build(rows.coalesce(1), str(tmp_path / "a"), ("t",), "key")
    later = spark.createDataFrame([("r1", "N99999 again"), ("new", "again N1")], "key string, t string")
    index.add(later, "key")
    every = rows.filter("NOT key <=> 'r1'").unionByName(later)
    for query in ("n5 ", "n4_999", "99%é😀", "é😀x", "again", "n1", "none of these"):
        want = sorted(r["key"] or "" for r in every.filter(has_keyword(query, ("t",))).collect())
        assert sorted(r["key"] or "" for r in index.find(every, query, "key").collect()) == want, query
    empty = rows.filter("key = 'nobody'")
    assert text_index.build(empty, str(tmp_path / "e"), ("t",), "key").find(empty, "n5 ", "key").count() == 0


def test_trigram_numbers_of_texts_of_any_length():
    rng = np.random.default_rng(3)
    long = "".join(map(chr, rng.integers(0x4E00, 0x4F00, text_index.BLOCK_POSTINGS + 5)))
    for text in ("", "a", "ab", "abc", "\0\0\0\0", "😀é😀é😀", long[: text_index.BLOCK_POSTINGS + 2], long):
        want = {ord(text[i]) << 42 | ord(text[i + 1]) << 21 | ord(text[i + 2]) for i in range(len(text) - 2)}
        got = text_index.keys(text.encode())
        assert len(got) == len(want) and set(got.tolist()) == want
    lists, held = np.array([3, 3, 3, 8, 9, 9]), np.array([0, 1, 32767, 300, 0, 255])
    starts, coded = text_index.gaps(lists, held)
    assert starts.tolist() == [0, 3, 4] and [text_index.rows_of(x.as_py()).tolist() for x in coded] == [[0, 1, 32767], [300], [0, 255]]


def test_names_that_hold_others(spark):
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("abc_") for _ in range(rng.randint(0, 9))) for _ in range(150)})
    long, short = names[::2], names[1::2]
    got = text_index.containing(spark.createDataFrame([(x, i) for i, x in enumerate(long)], "long string, i int"), spark.createDataFrame([(x, -i) for i, x in enumerate(short)], "short string, j int"))
    assert sorted((r["long"], r["short"]) for r in got.collect()) == sorted((x, y) for x in long for y in short if y and y in x)


# --- chunk store --------------------------------------------------------------------------------

STORED = "url string, chunk_number int, content string"


class Plain:
    """The store's rules over a dict, one load after another."""

    def __init__(self):
        self.rows = {}

    def load(self, rows, replace, deletes):
        for url in {u for u, _, _ in rows if replace} | set(deletes):
            self.rows = {k: v for k, v in self.rows.items() if k[0] != url}
        for url, n, text in rows:
            self.rows[url, n] = text


def held(df):
    return sorted(((r["url"], r["chunk_number"], r["content"]) for r in df.collect()), key=repr)


def test_store_against_a_dict(spark, tmp_path):
    rng = random.Random(3)
    store, plain, seen = ChunkStore(spark, str(tmp_path / "s"), STORED), Plain(), []
    assert held(store.rows()) == []
    for step in range(9):
        rows = [(rng.choice(["a", "b", "c", "d", None]), rng.randint(0, 3), f"{step}.{i}") for i in range(rng.randint(0, 6))]
        deletes = rng.sample(["a", "b", "c", "e"], rng.randint(0, 2))
        replace = rng.random() < 0.4
        gone = spark.createDataFrame([(u,) for u in deletes], "url string") if deletes else None
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], STORED + ", nth int")
        store.load(df.repartition(3), position=F.col("nth"), replace=replace, deletes=gone)
        plain.load(rows, replace, deletes)
        if step in (3, 6):
            store.compact()
        want = sorted(((u, n, t) for (u, n), t in plain.rows.items()), key=repr)
        assert held(store.rows()) == want, step
        seen.append((store.version().number, want))
    for number, want in seen:
        assert held(store.rows(number)) == want
    store.forget(keep=3)
    assert len(store.versions()) == 3 and held(store.rows()) == seen[-1][1]


def test_a_failed_load_leaves_the_last_version(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), STORED)
    rows = spark.createDataFrame([("u", 0, "a")], STORED)
    store.load(rows)
    bad = rows.withColumn("content", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.load(bad)
    assert held(store.rows()) == [("u", 0, "a")] and store.versions() == [1]
    store.load(rows.withColumn("content", F.lit("b")))  # over what the failed one has left
    assert held(store.rows()) == [("u", 0, "b")] and held(store.rows(1)) == [("u", 0, "a")]


def test_two_writers_and_repeated_loads(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), STORED)
    rows = spark.createDataFrame([("u", 0, "a")], STORED)
    store.load(rows, stream=("x", 0))
    assert store.load(rows.withColumn("content", F.lit("b")), stream=("x", 0)).number == 1  # the batch runs again
    before = store.version()
    store.load(rows)
    with pytest.raises(Conflict):
        store._commit(before.__class__(before.number + 1, None, (), {}))
    assert len(store.versions()) == 2


def test_a_load_costs_as_much_as_it_holds(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), STORED)
    store.load(spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(0).alias("chunk_number"), F.lit("text").alias("content")))
    store.compact()
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "s").rglob("*") if f.is_file())
    before = size()
    store.load(spark.createDataFrame([("u5", 0, "new"), ("u19999", 0, "new")], STORED), replace=True)
    assert size() - before < 20_000 < before
    assert store.rows().filter("content = 'new'").count() == 2 and store.rows().count() == 20_000


def test_streamed_upserts_keep_the_last_text(spark, tmp_path):
    src = tmp_path / "in"
    batches = [
        [("u", 1, "old long text that was first, " * 20), ("u", 2, "new short"), ("v", 1, "one"), ("v", 1, "tie")],
        [("w", 1, "x"), ("u", 1, "of a later batch"), ("gone", 5, "text " * 100), ("gone", 6, None)],
        [("v", 0, "y" * 300)],
    ]
    for replace in (True, False):
        store = ChunkStore(spark, str(tmp_path / f"out{replace}"), incremental.CHUNKS)
        folder = str(src) + str(replace)
        for batch in batches:
            spark.createDataFrame(batch, "url string, n int, text string").coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema("url string, n int, text string").parquet(folder)
            incremental.stream_upserts(stream, store, str(tmp_path / f"check{replace}"), 100, order="n", replace=replace, compact_after=2).awaitTermination()
        rows = held(store.rows())
        assert [r for r in rows if r[0] == "u"] == [("u", 0, "of a later batch")]
        assert [len(r[2]) for r in rows if r[0] == "v"] == [100, 100, 100] and not [r for r in rows if r[0] == "gone"]


# --- the limiter ---------------------------------------------------------------------------------


def simulated(requests, per_minute, burst):
    """Request by request, as a caller that sleeps would have it; times in seconds."""
    out, times, clock, errors, failed = {}, [], 0.0, 0, 0.0
    for ts, id_, ok, status in sorted(requests):
        now = max(ts, clock)
        while True:
            minute, ten = [t for t in times if now - t < 60], [t for t in times if now - t < 10]
            if len(minute) >= per_minute:
                now = min(minute) + 60
            elif len(ten) >= burst:
                now = min(ten) + 10
            else:
                break
        times.append(now)
        clock = max(now, failed + min(2**errors, 30)) if errors else now
        out[id_] = clock
        if ok:
            errors = 0
        else:
            failed = clock
            errors += status == 429 or status >= 500
    return out


@pytest.mark.parametrize(("per_minute", "burst"), [(3, 2), (60, 3), (60, 10), (2, 5), (1, 1)])
def test_release_against_a_simulation(per_minute, burst):
    rng = random.Random(per_minute * 100 + burst)
    for _ in range(20):
        ts, requests = 0, []
        for i in range(120):
            ts += rng.choice([0, 0, 1, 2, 7, 30, 61]) if rng.random() < 0.8 else 0
            ok = rng.random() < 0.7
            requests.append((ts, i, ok, 200 if ok else rng.choice([429, 500, 404])))
        client = limiter.Client()
        got = {i: client.release(ts * limiter.SECOND, ok, status, per_minute, burst) / limiter.SECOND for ts, i, ok, status in requests}
        assert got == simulated(requests, per_minute, burst)
        assert len(client.times) <= max(per_minute, burst)


def test_limiter_across_batches(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2026, 1, 1)
    rows = {c: [] for c in (1, 2, 3)}
    for c in rows:
        ts = 0
        for i in range(40):
            ts += rng.choice([0, 1, 3, 20])
            ok = rng.random() < 0.8
            rows[c].append((ts, 1000 * c + i, ok, 200 if ok else 429))
        rows[c].append((ts + 1, 1000 * c + 99, True, 200))  # no open run of errors
    every = sorted((ts, c, id_, ok, status) for c in rows for ts, id_, ok, status in rows[c])
    at = lambda s: start + dt.timedelta(seconds=s)
    schema = "client bigint, id bigint, ts timestamp, ok boolean, status int"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [every[:40], every[40:41], every[41:90], every[90:], [(10_000, 9, 9, True, 200)], [(20_000, 9, 10, True, 200)]]
    for part in parts:
        some = part[:]
        rng.shuffle(some)  # out of order within a batch
        spark.createDataFrame([(c, i, at(ts), ok, status) for ts, c, i, ok, status in some], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        with limiter.state_store(spark):
            limiter.limited(stream, 3, 2, "1 second").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = {r["id"]: (r["released_at"] - start).total_seconds() for r in spark.read.parquet(out).collect() if r["client"] != 9}
    want = {}
    for c in rows:
        want |= simulated(rows[c], 3, 2)
    assert got == want and max(want[i] - ts for c in rows for ts, i, _, _ in rows[c]) > 60  # they do wait
    past = spark.read.format("statestore").option("stateVarName", "past").load(str(tmp_path / "log"))
    assert {r["key"]["client"] for r in past.select("key").collect()} <= {9}  # idle clients leave no state


# --- the kept graph ----------------------------------------------------------------------


def test_imports_meet_top_modules_by_prefix_not_by_a_list(spark):
    from strataweave.operators import graph_store

    made = [("a/x.py", "import my_mocks.deep\nimport zz\nimport os\nimport far\nfrom . import y\n"), ("my/z.py", ""), ("far/w.py", "")]
    files = spark.createDataFrame(made, "path string, source string")
    rows = graph_store.parsed(graph_store.named(files), "r").unionByName(graph_store.parsed(graph_store.named(spark.createDataFrame([("zz.py", "import my_mocks\n")], "path string, source string")), "other"))
    seen = {}
    keep = graph_store.graph.import_edges
    graph_store.graph.import_edges = lambda internal, file: seen.setdefault("internal", internal)
    try:
        graph_store.assembled(rows)
    finally:
        graph_store.graph.import_edges = keep
    assert sorted(tuple(r) for r in seen["internal"].collect()) == [("a/x.py", "."), ("a/x.py", "far"), ("a/x.py", "my_mocks.deep")]
    # A list of all modules beside every import is quadratic.
    assert "collect_set" not in seen["internal"]._jdf.queryExecution().optimizedPlan().toString().replace("collect_set(regexp_replace", "")


def test_vectors_are_scaled_by_a_length_that_is_summed_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0],)], "v array<double>").select(vector_index.unit(F.col("v"), 2).alias("u"))
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], None, None, None]
    assert "/ sqrt" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_all_queries_meet_all_rows_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 7)  # several blocks of rows and of queries
    rng = np.random.default_rng(4)
    made = rng.normal(0, 1, (90, 6)).astype(np.float32).astype(float)
    made[50:80] = made[3]  # a crowd of copies ties, the smallest ids standing
    rows = spark.createDataFrame([(i, f"s{i}", [float(x) for x in v]) for i, v in enumerate(made)], "id bigint, source_id string, embedding array<double>")
    index = vector_index.build(rows, f"file://{tmp_path}/blocks", lists=4)
    got = index.match_all(rows.filter("id < 10").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 4)
    unit = made / np.linalg.norm(made, axis=1)[:, None]
    want = {q: sorted(range(90), key=lambda i: (-round(float(unit[i] @ unit[q]), 9), i))[:4] for q in range(10)}
    assert {q: [r["id"] for r in sorted((r for r in got.collect() if r["query_id"] == q), key=lambda r: (-r["similarity"], r["id"]))] for q in range(10)} == want
    assert "source_id" in got.columns


def test_a_store_keeps_its_rows_compressed(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/zstd", "url string, chunk_number int, content string")
    made = store.load(spark.createDataFrame([("u", i, "text " * 50) for i in range(20)], "url string, chunk_number int, content string"), deletes=spark.createDataFrame([("v",)], "url string"))
    assert store.loaded(made) == 20 == store.rows().count()
    store.compact()
    files = [p.name for p in (tmp_path / "zstd").rglob("*.parquet") if p.is_file()]
    assert files and all(".zstd." in n for n in files) and store.rows().count() == 20


def test_ingest_writes_chunks_once(spark, tmp_path):
    from pathlib import Path

    from strataweave import shared
    from strataweave.operators import embedding
    from strataweave.plans import resumable
    from strataweave.plans.config import EngineConfig

    tables = Path(shared.session_dir(spark).removeprefix("file://"))
    before = set(tables.glob("made-*"))
    made = resumable.Ingest(spark, f"file://{tmp_path}/once", EngineConfig(chunk_size=100), embedding.HashedWords(8))
    pages = spark.createDataFrame([(f"https://a.com/{i}", "A text of words. " * 20) for i in range(5)], "url string, markdown string")
    done = made.run(pages)
    assert done["pages"] == 5 and done["chunks"] == made.corpus().chunks.count() > 5
    assert not [p for p in set(tables.glob("made-*")) - before if "made-sources" not in p.name]
    assert set(made.run(pages).values()) == {0}


def test_trigrams_across_pieces_in_time_by_length(spark):
    texts = ["", "ab", "abc", "é😀x" * 30, "".join(chr(0x4E00 + i) for i in range(101)), "".join(chr(0x4E00 + i % 20000) for i in range(60_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text_index.grams(F.col("t")).alias("g"))
    for r in df.collect():
        t = texts[r["i"]]
        assert r["g"] == list(dict.fromkeys(t[j : j + 3] for j in range(len(t) - 2)))
    assert "transform(transform" in df._jdf.queryExecution().optimizedPlan().toString()
