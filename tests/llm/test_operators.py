"""The operators against brute force, on the small tables and on awkward rows."""

import base64
import hashlib
import html as entities
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataweave.llm import html_text, mixing, neighbours, packing, quality_classifier, quality_rules, sharding, simhash, token_counts, warc
from strataweave.llm.components import components
from strataweave.llm.queries import QUERIES, vocabulary

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
VOCABULARY = vocabulary("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, length string, _x int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
AWKWARD = [
    (1, None, "en", "a", None, "x", 1), (2, "", None, None, 0, "x", 1), (3, " \t\n", "en", "a", 3, None, 1), (4, "one", "en", "a", 3, "x", 1),
    (5, "one two", "en", "b", 7, "x", 1), (6, LONG, "de", "b", 9, "x", 1), (7, LONG + " end", "de", "b", 9, "x", 1), (8, "same text here again", "fr", "c", 1, "x", 1),
    (8, "same text here again", "fr", "c", 1, "x", 1), (None, "no id at all here", "fr", "c", 1, "x", 1), (9, "Ünï <|endoftext|> don't 12.5%,  x", "fr", "c", 1, "x", 1),
    (10, "a b c d e f g h " * 4, "fr", "c", 1, "x", 1), (11, "line one is here\nline one is here\n\nline two", "fr", "c", 1, "x", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def words(text):
    return WORD.findall((text or "").encode())


# --- 1 packing ---------------------------------------------------------------------


@cache
def tokenizer(plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = plain
    return t


def ids_of(text, plain=False):
    return [*tokenizer(plain).encode(text or "", add_special_tokens=False).ids, 0]


def test_words_encode_as_the_tokenizer_does(documents):
    encode = packing.encoder(VOCABULARY).encode
    rng = random.Random(1)
    chars = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x180), 0x300, 0x301, 0x2019, 0x3A3, 0x1E9E, 0x65E5, 0x1F44D)]
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|><|endoftext|>", "don't 'tis we're, a'b ''s x's.", "tab\tnew\nline\x1c\x85\xa0 x", "İstanbul ŉ ſ ΣΑΣ àb"]
    texts += ["".join(rng.choice(chars) for _ in range(40)) for _ in range(500)] + [r["text"] for r in documents.collect()]
    for text in texts:
        assert encode((text or "").encode()) == np.array(ids_of(text)[:-1], dtype="<u4").tobytes(), text


def check_packed(rows, texts, capacity):
    got, want = Counter(), Counter()
    by = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts:
        ids = np.array(ids_of(text), dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert got == want
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, awkward, documents, none, monkeypatch):
    check_packed(packing.pack_documents(awkward, VOCABULARY).collect(), [(r[0], r[1]) for r in AWKWARD], 2048)
    rows = packing.pack_documents(documents, VOCABULARY).collect()
    n = check_packed(rows, [(r["doc_id"], r["text"]) for r in documents.collect()], 2048)
    monkeypatch.setattr(packing, "RANK_ROWS", 5)
    check_packed(packing.pack_documents(documents, VOCABULARY, capacity=64).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()], 64)
    check_packed(packing.pack_documents(awkward.limit(1), VOCABULARY, capacity=1).collect(), [(1, None)], 1)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1
    assert packing.pack_documents(none, VOCABULARY).count() == 0


def test_best_two_fit():
    # Greedy takes 6 + 3 and leaves 1; the pair 2 + 2 fills the gap of 4 that 3 leaves.
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == ([(6, 1), (2, 2)], 1)
    rng = random.Random(3)
    for _ in range(60):
        counts = dict(Counter(rng.randint(1, 50) for _ in range(rng.randint(1, 300))))
        plan = packing.best_two_fit(counts, 50)
        used = Counter()
        for bin_, times in plan:
            assert sum(n * k for n, k in bin_) <= 50 and times > 0
            for n, k in bin_:
                used[n] += k * times
        assert used == Counter(counts)
        bins = sum(t for _, t in plan)
        assert bins <= 1.1 * math.ceil(sum(n * c for n, c in counts.items()) / 50) + 1
    with pytest.raises(ValueError):
        packing.best_two_fit({51: 1}, 50)


# --- 2 token counts -----------------------------------------------------------------


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 64, 10_000])
def test_separator_scan(spark, cut):
    rng = np.random.default_rng(cut)
    rows, want = [], set()
    for file in range(4):
        ids = np.where(rng.random(500 * (file > 0)) < 0.15, 9, rng.integers(0, 9, 500 * (file > 0))).astype("<u2")
        if file == 3:
            ids = np.full(40, 1, dtype="<u2")  # no separator at all
        start, ordinal = 0, 0
        for at in np.flatnonzero(ids == 9):
            want.add((file, ordinal, start, int(at) - start, True))
            start, ordinal = int(at) + 1, ordinal + 1
        if start < len(ids):
            want.add((file, ordinal, start, len(ids) - start, False))
        rows += [(file, b, ids[a : a + cut].tobytes()) for b, a in enumerate(range(0, len(ids), cut))]
    blocks = spark.createDataFrame(rows + [(7, 0, None), (7, 1, b"")], "file bigint, block bigint, tokens binary")
    assert {tuple(r) for r in token_counts.count_tokens(blocks, 9).collect()} == want


def test_flat_files(spark, tmp_path):
    ids = np.array([5, 5, 9, 9, 5, 9, 5], dtype="<u2")
    (tmp_path / "t.bin").write_bytes(ids.tobytes())
    got = token_counts.count_tokens(token_counts.blocks_of_files(spark, str(tmp_path), block_tokens=2), 9).orderBy("ordinal").collect()
    assert [(r["start"], r["n_tokens"], r["closed"]) for r in got] == [(0, 2, True), (3, 0, True), (4, 1, True), (6, 1, False)]
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "odd.bin").write_bytes(np.array([9] * 7, dtype="<u2").tobytes() + b"x")
    many = token_counts.count_tokens(token_counts.blocks_of_files(spark, str(tmp_path), block_tokens=2, range_blocks=1), 9).collect()
    assert len(many) == 4 + 7 and sum(r["closed"] for r in many) == 3 + 7


def test_token_counts_of_documents(awkward, none):
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.document_counts(awkward, VOCABULARY, 49407).collect())
    assert got == Counter((r[0], len(ids_of(r[1], plain=True)) - 1) for r in AWKWARD)
    assert token_counts.document_counts(none, VOCABULARY, 49407).count() == 0


# --- 3 neighbours --------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    rows += [(300 + i, [float(v) for v in x[0]]) for i in range(50)]  # many copies of one
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] * 4), (404, [1.0]), (405, []), (None, [1.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    known = {i: np.array(v) for i, v in rows if i is not None and i < 350}
    assert set(got) == {i for i in known if i % 50 == 0}
    for q, found in got.items():
        scores = sorted(((-float(known[q] @ v / np.linalg.norm(known[q]) / np.linalg.norm(v)), i) for i, v in known.items() if i != q))
        assert np.allclose([s for _, s in found], [-s for s, _ in scores[:5]], atol=1e-12)
        if q in (0, 300):
            assert [i for i, _ in found] == [i for i in (0, 300, 301, 302, 303, 304) if i != q][:5]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 7"), F.lit(True)).count() == 0


def test_neighbours_that_tie(spark, monkeypatch):
    """Multiples of one vector tie with one another, over many chunks and parts; extra columns bear the operator's own names."""
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 16)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    rows = [(1000 - i, [float(v * 2.0 ** (i % 7)) for v in (1.0, 2.0, 0.5, 0.0)], 1, "v") for i in range(90)] + [(i, [float(v) for v in r], 2, "h") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, c int, v string").withColumns({n: F.lit("theirs") for n in ("h", "q", "cell", "leaves", "id", "part")})
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    known = {i: np.array(v, dtype=np.float32).astype(float) for i, v, *_ in rows}
    assert set(got) == {i for i in known if i % 10 == 0}
    for q, found in got.items():
        scores = {i: float(neighbours.cosine(known[q][None], v[None])[0]) for i, v in known.items() if i != q}
        assert found == sorted(scores, key=lambda i: (-scores[i], i))[:5]


def test_clustered_vectors_meet_few(spark, monkeypatch):
    """On clusters a small share finds nearly all, and most vectors are never met."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(100, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(30, 16)) for c in centres])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, share=0.05).collect():
        got[r["query_id"]].add(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = {q: set(np.argsort(-np.where(np.arange(len(u)) == q, -9, u @ u[q]))[:5]) for q in range(0, len(u), 50)}
    assert np.mean([len(got[q] & best[q]) / 5 for q in best]) > 0.9


def test_recall(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 5 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for i in np.flatnonzero(ids % 5 == 0):
        s = x @ x[i]
        s[i] = -9
        hits += len(got[ids[i]] & set(ids[np.argsort(-s)[:5]]))
    assert hits >= 0.9 * 5 * len(got)


# --- 4 WARC ----------------------------------------------------------------------------

PAGES = [(1, "http://h/a", "<p>x</p>", 1), (2, "http://h/b", "<p>x</p>", 1), (3, None, None, 1), (4, "http://h/c d", "", 1), (None, "u", "<p>x</p>", 1), (5, "ü", "ä" * 50_000, 1), (2, "http://h/b", "<p>x</p>", 1), (None, "v", "alone", 1)]


def test_warc(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string, _sha int")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    last = {}
    for p, _, h, _ in PAGES:
        last[h or ""] = max(last.get(h or "", -1), p if p is not None else -1)
    want = Counter()
    for p, _, h, _ in PAGES:
        data, first = (h or "").encode(), last[h or ""]
        other = first >= 0 and p != first
        want[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", first if other else None] += 1
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.round_trip(df, least=100_001).collect()} == {"response"}


def test_archives_carry_a_dictionary():
    rng = random.Random(1)
    vocab = [f"<div class='c{i}'>word{i}</div>" for i in range(50)]
    pages = ["".join(rng.choices(vocab, k=40)) for _ in range(400)]
    writer = warc.ArchiveWriter(train_bytes=100_000)
    for i, p in enumerate(pages):
        writer.add(warc.record(i, "http://h/", p.encode(), "2026-01-01T00:00:00Z"))
    data = writer.close()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE_MAGIC
    read = list(warc.read_archive(data))
    assert [b.partition(b"\r\n\r\n")[2].decode() for _, b in read] == pages
    assert [f["X-Page-Id"] for f, _ in read] == [str(i) for i in range(400)]


# --- 5 quality rules ---------------------------------------------------------------------


def figures(text):
    w = words(text)
    text = text or ""
    lines = [x for x in text.split("\n") if words(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)}
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_figures(awkward, documents, none):
    for df in (awkward, documents):
        want = Counter((r["doc_id"], *(f := figures(r["text"])), f[0] < 20 or 100 * f[4] > 30 * f[0]) for r in df.collect())
        got = quality_rules.judge(df).collect()
        assert Counter(tuple(r)[:7] for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.judge(none).count() == 0
    assert quality_rules.filter_documents(none).count() == 0


def test_cascade_is_the_same_in_any_order(awkward, documents):
    for df in (awkward, documents):
        kept = Counter(r["doc_id"] for r in quality_rules.filter_documents(df).collect())
        judged = Counter(r["doc_id"] for r in quality_rules.judge(df).collect() if r["kept"])
        assert kept == judged
    assert quality_rules.filter_documents(awkward).columns == awkward.columns
    order = quality_rules.plan(documents)
    assert [m.rank for m in order] == sorted((m.rank for m in order), reverse=True)


def test_a_costly_rule_moves_back(documents, awkward, none):
    """Rules that reject the same rows at different costs; and rules that reject more or less at one cost."""
    short = lambda n: (lambda: F.size("_words") < n)
    R = quality_rules.Rule
    rules = (R("detour", short(60), quality_rules.words(5000)), R("few", short(30)), R("many", short(60)))
    for _ in range(2):
        found = {m.rule.name: m for m in quality_rules.plan(documents, rules)}
        assert list(found) == ["many", "few", "detour"]
        assert found["detour"].rejection == found["many"].rejection > found["few"].rejection > 0
    rows = documents.collect()
    assert found["detour"].cost_ns == pytest.approx(5000 * sum(len(words(r["text"])) for r in rows) / len(rows))
    # The same order on every run and however the rows lie in partitions; nothing to plan on is no error.
    orders = [[m.rule.name for m in quality_rules.plan(df)] for df in (documents, documents, documents.repartition(7))]
    assert orders[0] == orders[1] == orders[2]
    assert [m.rule for m in quality_rules.plan(none)] == [*quality_rules.RULES] and len(quality_rules.plan(awkward)) == len(quality_rules.RULES)


# --- 6 classifier -------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = quality_classifier.score_documents(spark.read.parquet(f"{data}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.select("doc_id", "held_out").collect())


def numbers(text):
    """The counts of quality_classifier.counts(), in plain Python."""
    w = [x.decode() for x in words(text)]
    text = text or ""
    lines = [x for x in text.split("\n") if words(x)]
    many = lambda chars: sum(text.count(c) for c in chars)
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    return len(w), sum(map(len, w)), many("#*$%&|<>"), many("!"), upper, sum(a == b for a, b in zip(w, w[1:], strict=False)), len(set(w)), len(lines) - len(set(lines)), len(lines), many("0123456789"), many(".,;:")


def test_classifier_against_numpy(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = docs.select("doc_id", "text").collect()
    x = []
    for r in rows:
        n, c, sym, exc, up, adj, dis, dup, lin, dig, pun = numbers(r["text"])
        m, k = max(n, 1), max(c, 1)
        x.append([math.log1p(n), *(math.log(a / b + e) for a, b, e in ((c, m, 0.5), (sym, m, 0.05), (exc, m, 0.05), (up, k, 0.02), (adj, m, 0.05)))])
        x[-1] += [math.log(max(dis, 1) / m**0.93), *(math.log(a / b + e) for a, b, e in ((dup, max(lin, 1), 0.1), (dig, k, 0.05), (pun, m, 0.05)))]
    x = np.array(x)
    label = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    y = np.array([label.get(r["doc_id"], -1) for r in rows])
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    share = [np.mean(y[y >= 0] == k) for k in (0, 1)]
    common = share[0] * cov[0] + share[1] * cov[1]
    logs = []
    for k in (0, 1):
        s = (1 - quality_classifier.POOLED) * cov[k] + quality_classifier.POOLED * common + quality_classifier.RIDGE * np.trace(common) / len(common) * np.eye(len(common))
        d = x - x[y == k].mean(axis=0)
        logs.append(math.log(share[k]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    want = {r["doc_id"]: 1 / (1 + math.exp(min(a - b, 700))) for r, a, b in zip(rows, *logs, strict=True)}
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score_documents(docs, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in got) < 1e-6


def test_classifier_edges(spark, awkward, none, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    nothing = labels.limit(0)
    assert quality_classifier.score_documents(none, labels).count() == 0
    assert {r["score"] for r in quality_classifier.score_documents(awkward, nothing).collect()} == {0.5}
    one = labels.filter("quality = 1")
    assert {r["score"] for r in quality_classifier.score_documents(documents, one).collect()} == {1.0}
    assert quality_classifier.score_documents(awkward, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")).count() == len(AWKWARD)
    assert quality_classifier.filter_documents(awkward, nothing).columns == awkward.columns


# --- 7 sharding ----------------------------------------------------------------------------


def test_sharding(spark, documents, awkward, none):
    for df, limit in ((documents, 20_000), (documents, 1 << 30), (awkward, 1000)):
        rows = sharding.shard(df, limit).collect()
        sizes, n, prefixes = Counter(), Counter(), {r["shard"] for r in rows}
        for r in rows:
            sizes[r["shard"]] += r["bytes"]
            n[r["shard"]] += 1
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in df.collect())
        for r in rows:
            assert r["shard_bytes"] == sizes[r["shard"]] and r["n_docs"] == n[r["shard"]]
            assert r["shard_bytes"] <= limit or r["n_docs"] == 1
        assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)
        for p in prefixes - {""}:  # only what was too large was split
            assert sum(v for q, v in sizes.items() if q.startswith(p[:-1])) > limit
    assert sharding.shard(none).count() == 0


def test_one_id_over_the_limit_is_split(spark):
    df = spark.createDataFrame([(1, "x" * 100)] * 60 + [(2, "y" * 10)], "doc_id bigint, text string")
    rows = sharding.shard(df, 1000).collect()
    assert len(rows) == 61 and all(r["shard_bytes"] <= 1000 for r in rows)


# --- 8 SimHash ------------------------------------------------------------------------------


def simhash_of(text, k=3):
    w = words(text)
    w = [x.lower() for x in w]
    parts = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def linked(fps, tau=2):
    a = np.array(fps, dtype=np.uint64)
    return [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= tau) if j > i]


def test_simhash(spark, awkward, documents, none):
    for df in (documents, awkward):
        rows = df.select("doc_id", "text").collect()
        fps = [simhash_of(r["text"]) for r in rows]
        root = components_of(linked(fps), range(len(rows)))
        least = {}
        for i, r in enumerate(rows):
            if r["doc_id"] is not None:
                least[root[i]] = min(least.get(root[i], r["doc_id"]), r["doc_id"])
        want = Counter((r["doc_id"], f"{fps[i]:016x}", least.get(root[i])) for i, r in enumerate(rows))
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("crowd", [2, 48])
def test_links_lose_nothing_in_crowds(spark, crowd):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for _ in range(400):
        x = rng.choice([*base[:3], *rng.sample(sorted(fps), 3)])
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp bigint")
    edges = [(r["a"], r["b"]) for r in simhash.links(df, crowd=crowd).collect()]
    at = {simhash.signed(x): i for i, x in enumerate(fps)}
    got = components_of([(at[a], at[b]) for a, b in edges], range(len(fps)))
    assert got == components_of(linked(fps), range(len(fps)))


def test_thresholds_add_up():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 500).astype(np.uint64)
    masks = simhash.groups_of_bits(sample, 3)
    assert sum(map(int, masks)) == 2**64 - 1 and not int(masks[0]) & int(masks[1])
    for tau, n in ((2, 100), (2, 10**9), (1, 10**6)):
        assert sum(t + 1 for t in simhash.allot(sample, masks[: tau + 1], tau, n)) == tau + 1


def test_similar_groups(spark, none):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base[:20]):
        copy = list(b)
        for at in rng.sample(range(400), 4):
            copy[at] = "changed"
        rows += [(100 + i, " ".join(copy)), (200 + i, " ".join(b))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    assert kept == list(range(40))
    again = df.unionByName(df)
    assert sorted(r["doc_id"] for r in simhash.keep_one(again).collect()) == list(range(40))
    many = [(1000 + i, " ".join(base[30])) for i in range(5)] + [(2000 + i, " ".join([*base[31][: 399 - i % 90], *base[31][400 - i % 90 :]])) for i in range(90)]
    crowd = spark.createDataFrame(rows + many, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(crowd).collect()) == list(range(40))
    assert simhash.keep_one(none).count() == 0


def test_crowded_buckets_lose_no_links(spark, monkeypatch):
    """Every bucket is crowded and headed by an unrelated document."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(i, " ".join(f"x{rng.randrange(5000)}" for _ in range(400))) for i in range(20)]
    for i in range(12):
        copy = list(base)
        for at in rng.sample(range(400), 2):
            copy[at] = f"new{i}"
        rows.append((100 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(simhash, "band_bits", lambda n: 1)
    monkeypatch.setattr(simhash, "CELL", 3)
    monkeypatch.setattr(simhash, "plan_bands", lambda similarity, width: (4, 0.1515))
    got = {r["doc_id"]: r["root"] for r in simhash.similar_groups(df, F.col("doc_id"), crowd=2).collect()}
    assert len({got[100 + i] for i in range(12)}) == 1 and len(set(got.values())) == 21


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_similar_groups_hold_to_the_similarity(spark):
    """Pairs of known similarity around 0.8: none below is merged, nearly all from 0.8 on are."""
    rng = random.Random(3)
    rows, at = [], {}
    for i in range(400):
        base = [f"w{rng.randrange(50_000)}" for _ in range(300)]
        copy = list(base)
        for at_ in rng.sample(range(5, 295), 5 + i % 5):
            copy[at_] = f"new{i}"
        pair = " ".join(base), " ".join(copy)
        at[i] = jaccard(*pair)
        rows += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    root = {r["doc_id"]: r["root"] for r in simhash.similar_groups(df, F.col("doc_id")).collect()}
    found = {i: root[2 * i] == root[2 * i + 1] for i in at}
    below, above = [found[i] for i in at if at[i] < 0.8], [found[i] for i in at if at[i] >= 0.8]
    assert len(below) > 100 and len(above) > 100
    assert not any(below) and sum(above) >= 0.95 * len(above)
    assert simhash.plan_bands(0.8, 20)[0] == 85
    assert [simhash.band_bits(n) for n in (0, 1, 2**14, 2**18, 10**10)] == [16, 16, 16, 20, 36]


def test_wide_fingerprints_meet_by_the_pigeonhole(spark):
    """Correlated bits share a group, groups that tell nothing apart aren't probed, and no pair within tau bits is missed."""
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 2**63, (300, 3)).astype(np.uint64) << np.uint64(1)
    even = np.uint64(0x5555555555555555)
    fps[:, 0] = fps[:, 0] & even | (fps[:, 0] & even) << np.uint64(1)  # each bit has a twin beside it
    fps[:, 1] &= np.uint64(0xFF)
    tau = 8
    groups = simhash.wide_groups(fps, 16, tau, 10**6)
    assert sum(t + 1 for _, _, t in groups) == tau + 1 and all(int(m).bit_count() == 16 for _, m, _ in groups)
    assert all(int(m) & 0x5555555555555555 == int(m) >> 1 & 0x5555555555555555 for w, m, _ in groups if w == 0)
    assert len({w for w, _, _ in groups}) < 3 and any(t > 0 for _, _, t in groups)
    for i in range(150):
        fps[150 + i] = fps[i]
        for bit in rng.choice(192, tau, replace=False):
            fps[150 + i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    df = spark.createDataFrame([(i, [simhash.signed(x) for x in row]) for i, row in enumerate(fps)], "id bigint, bits array<bigint>")
    buckets = {r["id"]: {*r["b"]} for r in df.select("id", simhash.probed(groups).alias("b")).collect()}
    apart = lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j]).sum())
    close = [(i, j) for i in range(300) for j in range(i) if apart(i, j) <= tau]
    assert len(close) >= 150 and all(buckets[i] & buckets[j] for i, j in close)


def test_near_duplicates_follow_the_thresholds(spark, monkeypatch):
    """The stage probes what the planner deals out, here half of the groups with threshold one."""
    asked = []

    def deal(sample, masks, tau, n, *more):
        asked.append((sample.shape, len(masks), tau, n))
        return [1 if g % 2 else -1 for g in range(len(masks))]

    monkeypatch.setattr(simhash, "allot", deal)
    rng = random.Random(15)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(60)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join(near(b, rng, 2, "n"))) for i, b in enumerate(base)]
    got = {r["doc_id"]: r["root"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id")).collect()}
    units = simhash.plan_bands(0.8, simhash.band_bits(120))[0]
    assert asked == [((120, -(-units // 4) * 4), -(-units // 4) * 4, units - 1, 120)]
    assert len(set(got.values())) == 60 and all(got[i] == got[100 + i] for i in range(60))


def near(base, rng, changes, mark):
    copy = list(base)
    for at in rng.sample(range(len(base)), changes):
        copy[at] = f"{mark}{rng.randrange(10**6)}"
    return copy


def test_narrow_bands_full_of_strangers(spark, monkeypatch):
    """What bands of a fixed width come to as a corpus grows: every bucket holds many unrelated texts."""
    rng = random.Random(12)
    base = [[f"w{rng.randrange(20_000)}" for _ in range(80)] for _ in range(2500)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(10_000 + i, " ".join(near(b, rng, 1, "n"))) for i, b in enumerate(base[:100])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(simhash, "band_bits", lambda n: 7)
    groups = {r["doc_id"]: r["root"] for r in simhash.similar_groups(df, F.col("doc_id")).collect()}
    assert sum(groups[10_000 + i] == groups[i] for i in range(100)) >= 98
    assert len({groups[i] for i in range(2500)}) == 2500


def test_a_long_common_passage_links_nothing(spark):
    """Hundreds of texts of pairwise similarity 0.68 stay apart; near copies of some go."""
    rng = random.Random(13)
    passage = [f"p{i}" for i in range(160)]
    base = [passage + [f"w{rng.randrange(10**6)}" for _ in range(38)] for _ in range(600)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(10_000 + i, " ".join(near(b, rng, 1, "n"))) for i, b in enumerate(base[:40])]
    assert 0.66 < jaccard(rows[0][1], rows[1][1]) < 0.7 and jaccard(rows[0][1], rows[600][1]) > 0.9
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i for i in range(600)} <= kept and len(kept) <= 601


def test_near_copies_of_one_text_and_of_each_other(spark):
    """A crowd around a hub, many of its members too far from the hub, against brute force."""
    rng = random.Random(14)
    hub = [f"h{i}" for i in range(150)]
    texts = [" ".join(near(hub, rng, rng.choice((1, 2, 3, 4, 6, 8)), f"n{i % 50}")) for i in range(220)]
    texts += [" ".join(near(t.split(), rng, 1, "m")) for t in texts[:60]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["root"] for r in simhash.similar_groups(df, F.col("doc_id")).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    want = components_of(pairs, range(len(texts)))
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
    assert all(want[i] == want[j] for i in got for j in got if got[i] == got[j])


def test_a_crowd_is_joined_by_node_and_makes_each_pair_once(spark, monkeypatch):
    """Members share most of their buckets: joins by node make a row for each, and a pair counts in one bucket."""
    made, real = [], simhash.unlinked
    monkeypatch.setattr(simhash, "unlinked", lambda *args: made.append(real(*args)) or made[-1])
    rng = random.Random(16)
    hub = [f"h{i}" for i in range(150)]
    texts = [" ".join(near(hub, rng, rng.choice((1, 2, 3, 4, 5, 6)), f"n{i}x")) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    first = store.executionsCount()
    got = {r["doc_id"]: r["root"] for r in simhash.similar_groups(df, F.col("doc_id")).collect()}
    bus.waitUntilEmpty()
    rows = 0
    for e in (x.apply(i) for x in [store.executionsList()] for i in range(first, x.size())):
        nodes, values = store.planGraph(e.executionId()).allNodes(), store.executionMetrics(e.executionId())
        for node in map(nodes.apply, range(nodes.size())):
            if re.search(r"Join \[node#\d+L?\], \[node#\d+L?\], Inner", node.desc()):
                ids = [m.accumulatorId() for m in map(node.metrics().apply, range(node.metrics().size())) if m.name() == "number of output rows"]
                rows += sum(int(values.apply(i).replace(",", "")) for i in ids if values.contains(i))
    assert 0 < rows <= 200
    pairs = [tuple(r) for r in made[0].collect()]
    assert len(pairs) == len(set(pairs)) > 100
    alike = [(i, j) for i in range(200) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert sum(got[i] == got[j] for i, j in alike) >= 0.95 * len(alike)


def test_similar_groups_of_documents(spark):
    """All pairs of the table by brute force: at least nine in ten links found, no other pair linked."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = [x.lower() for x in words(r["text"])]
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] * bool(w))
    places = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            places[x].append(d)
    shared = Counter(p for found in places.values() if len(found) > 1 for i, a in enumerate(found) for p in ((a, b) for b in found[i + 1 :]))
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    got = {r["doc_id"]: r["root"] for r in simhash.similar_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), F.col("doc_id")).collect()}
    assert len(pairs) > 30 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    want = components_of(pairs, sets)
    full = [d for d in got if sets[d]]
    assert len({(got[d], want[d]) for d in full}) == len({got[d] for d in full})  # no group joins what brute force keeps apart


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5000, 5001 + i) for i in range(200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs + [(7, 7)], "a bigint, b bigint")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    want = components_of(pairs, nodes | {x for p in pairs for x in p})
    assert got == {n: want[n] for n in nodes}
    assert components(spark.createDataFrame([(1, None)], "a bigint, b bigint")).count() == 0


# --- 9 mixing ----------------------------------------------------------------------------------


def test_shortages_go_to_siblings_first():
    tokens = {("d0", "en"): 100, ("d0", "de"): 10, ("d1", "en"): 1000}
    got = mixing.budgets(tokens, 200)
    assert got == {("d0", "en"): 90, ("d0", "de"): 10, ("d1", "en"): 100}
    assert mixing.budgets(tokens, 400) == {("d0", "en"): 100, ("d0", "de"): 10, ("d1", "en"): 290}
    assert mixing.budgets(tokens, 10**6) == {k: v for k, v in tokens.items()}
    assert mixing.budgets(tokens, 10**6, epochs=2.0) == {k: 2 * v for k, v in tokens.items()}
    assert mixing.budgets(tokens, 90, {("d0",): 2.0})[("d1", "en")] == 30
    assert mixing.budgets(tokens, 90, {("d0",): 0.0}) == {("d0", "en"): 0, ("d0", "de"): 0, ("d1", "en"): 90}
    assert mixing.budgets({}, 5) == {}


def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


@pytest.mark.parametrize("slices", [512, 3])
def test_prefix_of_the_seeded_order(documents, slices, monkeypatch):
    monkeypatch.setattr(mixing, "SLICES", slices)
    options = {"budget_share": 0.9, "epochs": 2.0, "weights": {("en",): 5.0}}
    rows = mixing.mix(documents, levels(), **options).collect()
    full = {r["doc_id"]: r for r in documents.withColumn("_row", F.xxhash64(*documents.columns)).collect()}
    size = {d: len(words(r["text"])) for d, r in full.items()}
    leaf = {d: (r["lang"], r["source"]) for d, r in full.items()}
    totals = Counter()
    for d in full:
        totals[leaf[d]] += size[d]
    given = mixing.budgets(totals, 0.9 * sum(totals.values()), options["weights"], 2.0)
    got = Counter((r["doc_id"], r["epoch"]) for r in rows)
    want = Counter()
    places = {}
    for e in range(3):
        for r in documents.select("doc_id", mixing.seeded(11, F.lit(e).cast("bigint"), F.xxhash64(*documents.columns)).alias("p")).collect():
            places[r["doc_id"], e] = r["p"]
    for name, total in totals.items():
        own = [d for d in full if leaf[d] == name and size[d]]
        for e in range(given[name] // total):
            want.update((d, e) for d in own)
        e, rest, at = given[name] // total, given[name] % total, 0
        for d in sorted(own, key=lambda d: places[d, e]):
            if at < rest:
                want[d, e] += 1
            at += size[d]
    assert got == want


def test_mixing_edges(awkward, none):
    rows = mixing.mix(awkward, levels(), budget_share=1.0)
    assert sum(r["tokens"] for r in rows.collect()) == sum(len(words(r[1])) for r in AWKWARD)
    assert mixing.mixed_documents(awkward, levels(), budget_share=1.0).count() == sum(bool(words(r[1])) for r in AWKWARD)
    twice = mixing.mixed_documents(awkward, levels(), budget_share=2.0, epochs=2.0)
    assert twice.columns == awkward.columns and twice.count() == 2 * sum(bool(words(r[1])) for r in AWKWARD)
    assert mixing.mix(none, levels()).count() == 0 and mixing.mixed_documents(none, levels()).count() == 0
    assert mixing.mix(awkward, levels(), budget=0).count() == 0


def test_repeated_rows_are_mixed_as_selected(spark, monkeypatch):
    same = [(1, "a b c d", "en", "s", "x")] * 7
    df = spark.createDataFrame([*same, *((10 + i, "e f g h", "en", "s", "x") for i in range(4))], "doc_id bigint, text string, lang string, source string, _row string")
    for budget, epochs in ((16, 1.0), (44, 1.0), (60, 2.0), (88, 2.0), (4, 1.0)):
        picked = Counter(r["doc_id"] for r in mixing.mix(df, levels(), budget=budget, epochs=epochs).collect())
        rows = mixing.mixed_documents(df, levels(), budget=budget, epochs=epochs)
        assert rows.columns == df.columns
        assert Counter(r["doc_id"] for r in rows.collect()) == picked
        assert sum(picked.values()) == budget / 4
    with monkeypatch.context() as m, pytest.raises(ValueError, match="leaves"):
        m.setattr(mixing, "MAX_LEAVES", 1)
        mixing.mix(df.withColumn("source", F.col("doc_id").cast("string")), levels(), budget=4)


def test_mixing_counts_tokens_as_packing_does(spark, awkward, documents):
    sizes = packing.pieces(awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), VOCABULARY).groupBy("doc_id").agg(F.sum("length")).collect()
    want = {d: n - 1 for d, n in sizes if n > 1}  # without the separator
    rows = mixing.mix(awkward, levels(), budget_share=1.0, tokenizer=VOCABULARY).collect()
    assert {r["doc_id"]: r["tokens"] for r in rows if r["doc_id"] is not None} == want
    blob = spark.createDataFrame([(1, base64.b64encode(bytes(range(256))).decode(), "en", "a")], "doc_id bigint, text string, lang string, source string")
    assert mixing.mix(blob, levels(), budget_share=1.0, tokenizer=VOCABULARY).first()["tokens"] > 50
    sizes = {d: n - 1 for d, n in packing.pieces(documents, VOCABULARY).groupBy("doc_id").agg(F.sum("length")).collect()}
    got = QUERIES["op9_mixing"](spark, DATA).collect()
    assert got and all(r["tokens"] == sizes[r["doc_id"]] for r in got)


# --- 10 HTML ---------------------------------------------------------------------------------------


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<nav><ul><li>Menu</li></ul></nav><article><h1>Ti&amp;tle</h1><p>One<br>two <b>th</b>ree</p></article><footer>&copy; f</footer>", "Ti&tle One two three"),
        ("<div class='ad'>Buy</div><main><p>a\n\t b</p><aside>no</aside><div class='comments'><p>me too</p></div><p>c</main>", "a b c"),
        ("<article><p><b>open<br><p>next</article><script>if (a < b) '<p>x</p>'</script><style>p{}</style>", "open next"),
        ("<p>no main</p><form>f<button>b</button></form><div id=cookie-banner>c</div>", "no main"),
        ("<article>cut off <p>here &lt; the", "cut off here < the"),
        ("<article>a < b and c > d</article><!-- gone --><article>two</article>", "a < b and c > d two"),
        ("<div hidden>h</div><div style='display: none'>i</div><div role=navigation>n</div><p class=lead>p</p>", "p"),
        ("<div class='menu'>m</div><div id=content class=with-sidebar><p>in</p></div><p>out</p>", "in"),
        ("", ""),
    ],
)
def test_markup(body, text):
    assert html_text.text_of(page(body), None) == text


STORY = "<p>A long story that goes on and on and on, in more words than all of the rest.</p>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<div class='wrapper nav-collapsed'><nav>n</nav><article>{STORY}</article></div>", STORY),
        (f"<div class='site ad-free'><article>{STORY}</article></div>", STORY),
        (f"<article>{STORY}<section id='binary-search'><p>more</p></section></article>", STORY + "more"),
        (f"<div class=story>{STORY}</div><article><p>Card one</p></article><article><p>Card two</p></article>", STORY + "Card one Card two"),
        (f"<div class=story>{STORY * 4}</div><article><p>Card one</p></article>", STORY * 4 + "Card one"),
        (f"<form id=aspnet><div class=menu>m</div><article>{STORY}</article><footer>f</footer></form>", STORY),  # a form around the page
        (f"<div class=widget><p>{STORY}</p></div><nav>n</nav>", STORY),  # nothing else is text
        (f"<article>{STORY}<div class='comments'>{STORY * 3}</div></article>", STORY),  # longer than the article
        (f"<aside><article>Card</article></aside><div>{STORY}</div>", STORY),
        (f"<article>{STORY}</article><article><p>Second</p></article>", STORY + "Second"),
        (f"<article>{STORY}<p>in <span class=ad>no</span>line</p></article>", STORY + "in line"),
        ("<nav>Only a menu</nav>", ""),
    ],
)
def test_names_mislead(body, text):
    assert html_text.text_of(page(body), None) == " ".join(re.sub("<[^>]*>", " ", text).split())


@pytest.mark.parametrize("body", ["<b>" * 20_000 + "</i>" * 20_000, "<div><p>" + "<b>" * 20_000 + "<p></p>" * 20_000, "<li><ul>" * 10_000 + "<li>" * 20_000, "</x>" * 40_000, "<div class=ad>" * 20_000, "<article>" * 20_000])
def test_long_pages_take_time_in_proportion(body):
    start = time.perf_counter()
    assert html_text.text_of(f"<article>x</article>{body}", None) == "x"
    assert time.perf_counter() - start < 3


def test_lcs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html_text.common(a, b))
        assert len(found) == best[-1][-1]
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in found)


def test_differencing(spark):
    lead = "<p>Site head</p>"
    rows = [
        (1, "http://h/a/1", page(lead + "<p>first text that is long enough</p><p>Site tail</p>")),
        (2, "http://h/a/2", page(lead + "<p>second text that is long enough</p><p>Site tail</p>")),
        (3, "http://h/z", page("<p>nothing shared here</p>")),
        (4, "http://other/a/1", page(lead + "<p>alone on its host</p>")),
        (5, "http://copy/1", page("<p>copied page</p>")),
        (6, "http://copy/2", page("<p>copied page</p>")),
        (7, None, None),
        (7, None, None),
        (8, "http://h/a/3", page("<article><p>Site head</p><p>kept as it is</p></article>")),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("key", F.lit(1)).withColumn("text", F.lit("x"))
    got = html_text.extract(df).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == "first text that is long enough" and text[2] == "second text that is long enough"
    assert text[3] == "nothing shared here" and text[4] == "Site head alone on its host"
    assert html_text.differenced(["x", "y"], [html_text.line_hash("y")]) == ["x", "y"]
    assert text[5] == text[6] == "copied page" and text[7] == "" and text[8] == "Site head kept as it is"
    assert len(got) == 9 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


def test_neighbours_by_path(spark):
    """Pages without a main element against a plain search of all pages of the host."""
    rng = random.Random(8)
    pages = {}
    for i in range(150):
        host, path = f"h{rng.randrange(4)}", "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) + f"/{i}"
        shared = [f"<p>menu {host} {j}</p>" for j in range(rng.randrange(1, 6))]
        own = [f"<p>own {i} {j} of this page</p>" for j in range(rng.randrange(0, 4))]
        pages[i] = (f"http://{host}{path}", page("".join(shared + own) if i % 3 else f"<main>{own}</main>" + "".join(shared)))
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in pages.items()], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    paths = {i: (u.split("/")[2], u[u.index("/", 7) :]) for i, (u, _) in pages.items()}
    order = sorted(paths, key=paths.get)
    prefix = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for at, i in enumerate(order):
        near = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order) and paths[order[k]][0] == paths[i][0]]
        twin = max(near, key=lambda j: prefix(paths[i][1], paths[j][1]), default=None)
        if twin is not None:  # no page of the host has a longer prefix in common
            assert prefix(paths[i][1], paths[twin][1]) == max(prefix(paths[i][1], paths[j][1]) for j in paths if j != i and paths[j][0] == paths[i][0])
        lines = [html_text.line_hash(x) for x in html_text.blocks(pages[twin][1])[1]] if twin is not None else None
        assert got[i] == html_text.text_of(pages[i][1], lines), i


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_every_page_is_differenced(spark, adaptive):
    """Pages with an article meet their neighbour's lines too, in one partition or several; markup then corrects the difference."""
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    story = [f"<article><h1>Title {i}</h1><p>{'shared passage' if i in (1, 2) else f'passage {i}'}</p></article>" for i in range(60)]
    rows = [(i, f"http://h/{i // 10}/{i:02}", page(f"<p>Site head</p>{x}<p>Own tail {i}</p>")) for i, x in enumerate(story)]
    df = spark.createDataFrame(rows + rows[:5], "page_id bigint, url string, html string")
    hashed = html_text.parsed(df, hashes=True)
    twins = {r["id"]: r for r in hashed.select("id", "key").distinct().join(html_text.neighbours(hashed), "key").collect()}
    assert len(twins) == 60
    for i, _, _ in rows:
        twin = i + 1 if i % 10 == 0 else i - 1
        assert twins[i]["twin"] == [html_text.line_hash(x) for x, _ in html_text.Page(rows[twin][2]).marked()], i
        assert twins[i]["twin_inside"] == [False, True, True, False]
    lines = [x for x, _ in html_text.Page(rows[2][2]).marked()]
    assert html_text.differenced(lines, twins[2]["twin"]) == ["Title 2", "Own tail 2"]
    got = [(r["page_id"], r["text"]) for r in html_text.extract(df).collect()]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == 65 and dict(got) == {i: " ".join(re.sub("<[^>]*>", " ", x).split()) for i, x in enumerate(story)}


def test_lines_that_repeat_are_aligned_by_bits():
    rng = random.Random(5)
    for n in (1, 2, 5, 30, 120):
        for _ in range(20):
            a, b = ([rng.randrange(2) for _ in range(rng.randrange(1, n + 1))] for _ in range(2))
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            found = sorted(html_text.common_by_bits(a, b))
            it = iter(b)
            assert len(found) == best[-1][-1] and all(any(a[i] == y for y in it) for i in found)
    start = time.perf_counter()
    assert len(html_text.common([1, *[0] * 20_000, 2], [3, *[0] * 19_000, 4])) == 19_000
    assert time.perf_counter() - start < 5


def test_awkward_pages():
    long = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    assert html_text.text_of(long, None) == " ".join(["word"] * 50_000)
    assert html_text.text_of("<article><p>a <a href=\"x>never closed", None) == "a never closed"
    assert html_text.text_of("<p>a</p><div class='x", None) == "a"
    assert html_text.text_of("<" * 20_000, None) == "<" * 20_000
    assert html_text.text_of("<p>x</p>" + "<a" * 20_000, None) == "x"
    assert html_text.text_of("<p>x</p><!-- open" + "<a" * 20_000, None) == "x"
    assert html_text.text_of("<p>1 < 2 </3>&lt;b> <", None) == "1 < 2 <b> <"


def test_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r["html"], re.S).group(1)
        plain = re.sub(r"<[^>]*(?:>|\Z)", "", re.sub(r"<(?:br|/?p|/?h\d)[^>]*>", " ", article))
        assert r["text"] == " ".join(entities.unescape(plain).split())


# --- pipeline ---------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert 0 < len(rows) <= before.count(), name
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before.collect()}
        before = spark.createDataFrame(rows, docs.schema)
    packed = C.STAGES[-1][1](spark, before, DATA).collect()
    check_packed(packed, [(r["doc_id"], r["text"]) for r in before.collect()], 2048)
    assert {r["doc_id"] for r in C.run(spark, DATA).collect()} == {r["doc_id"] for r in packed}


def test_pipeline_stages_on_awkward_rows(spark, awkward, none):
    import corpus_pipeline as C

    # Names that the stages use themselves.
    clash = awkward.withColumns({c: F.lit("theirs") for c in ("_text", "_words", "_n", "_kept", "_key", "_row", "_e", "tokens", "label", "key", "root")})
    for name, stage in C.STAGES:
        assert stage(spark, none, DATA).count() == 0, name
        rows = stage(spark, clash, DATA).collect()
        if name != C.STAGES[-1][0]:
            assert all(r["_text"] == r["_key"] == r["label"] == "theirs" for r in rows), name


def test_queries_equal_sql(spark):
    import duckdb

    from strataweave.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, DATA)
        columns = sorted(got.columns)
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall() if hasattr(con.sql("SELECT 1"), "fetchall") else []
        assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want), name
