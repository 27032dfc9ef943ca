"""Chunked encoding against the plain tokenizer."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from strataweave.llm import chunk_reuse
from strataweave.llm.packing import encoder
from strataweave.llm.queries import QUERIES, vocabulary

DATA = "/root/testdata/sf0.001"
VOCABULARY = vocabulary("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(VOCABULARY)
DOCS = "doc_id bigint, text string, key string, at int, part int, _row int"


def expected(text, tokenizer=PLAIN):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    said = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()


def check(rows, docs, tokenizer=PLAIN):
    got = Counter(tuple(r) for r in rows)
    assert got == Counter((doc, *expected(text, tokenizer)) for doc, text in docs)


def table(spark, docs):
    return spark.createDataFrame([(*d, "k", 1, 2, 3) for d in docs], DOCS)


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    check(QUERIES["op12_bpe_encoding"](spark, DATA).collect(), [(r["doc_id"], r["text"]) for r in docs])


def passages(rng, n):
    letters = "abcdefghij klmno ' ,. éü日🙂 3 "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(80, 1500))) for _ in range(n)]


@pytest.mark.parametrize("bits", [3, 6, 9])
def test_shared_passages(spark, bits):
    """Chunks cut in words, in very long words, beside blanks of all kinds, at special tokens."""
    rng = random.Random(bits)
    some = passages(rng, 6) + ["x" * 3000, "日" * 900, "<|endoftext|>" * 40, "a\x1cb\x85c\xa0d   é f " * 30, " \t\r\n\x0b\x0c" * 60]
    docs = [(i, "".join(rng.choice(some) for _ in range(rng.randint(1, 5)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " "), (103, "one"), (103, "one"), (None, some[0]), (104, "a" * 30_000 + " " + some[1] * 20), (105, "b" * 30_000), (106, "b" * 30_000)]
    check(chunk_reuse.encode_documents(table(spark, docs).repartition(5), VOCABULARY, bits=bits).collect(), docs)


def test_no_rows(spark):
    assert chunk_reuse.encode_documents(table(spark, []), VOCABULARY).collect() == []
    check(chunk_reuse.encode_documents(table(spark, [(1, "alone")]), VOCABULARY).collect(), [(1, "alone")])


def test_vocabulary_that_joins_across_blanks(spark):
    path = vocabulary("byte_bpe_50k.json")
    docs = [(1, "two  blanks and\n\nlines " * 200), (2, "two  blanks and\n\nlines " * 200), (3, None)]
    check(chunk_reuse.encode_documents(table(spark, docs), path).collect(), docs, Tokenizer.from_file(path))


def test_cuts_follow_content(monkeypatch):
    rng = random.Random(9)
    text = "".join(passages(rng, 40)).encode()
    chunks = lambda data: [data[a:b] for a, b in zip([0, *chunk_reuse.cuts(data)], chunk_reuse.cuts(data), strict=False)]
    assert b"".join(chunks(text)) == text
    for chunk in chunks(text):
        chunk.decode()
        assert len(chunk) <= chunk_reuse.MOST
    assert all(len(c) >= chunk_reuse.LEAST for c in chunks(text)[:-1])
    moved = chunks(b"something before it " + text)
    assert len(set(moved) & set(chunks(text))) > 0.9 * len(chunks(text))
    whole = chunk_reuse.cuts(text)
    monkeypatch.setattr(chunk_reuse, "BLOCK", 100)
    assert chunk_reuse.cuts(text) == whole  # blocks overlap by the hash's window
    assert chunk_reuse.cuts(b"") == []


def test_a_shared_chunk_is_encoded_once(spark):
    """Its text is written down once per task, however many texts hold it; texts of their own aren't written at all."""
    rng = random.Random(2)
    shared = passages(rng, 1)[0] * 3
    docs = [(i, shared) for i in range(40)] + [(100 + i, f"{i} alone") for i in range(40)]
    seen = []
    kept = chunk_reuse.stored
    try:
        chunk_reuse.stored = lambda df, label, *a: seen.append((label, kept(df, label, *a))) or seen[-1][1]
        check(chunk_reuse.encode_documents(table(spark, docs).coalesce(2), VOCABULARY).collect(), docs)
    finally:
        chunk_reuse.stored = kept
    spans = dict(seen)["spans"]
    n = len(set(chunk_reuse.cuts(shared.encode())))
    assert spans.filter("key is not null and part is not null").count() <= 2 * n
    assert spans.filter("at = -1").count() == 40
    assert encoder(VOCABULARY).by_word
