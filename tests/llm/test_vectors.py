"""Whitening and hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.llm import hard_negatives, whitening
from strataweave.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int, id string, _id int, component string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """Rows (id, vector, label), with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "x", 1, "c") for r in rows], VECTORS)


# --- 11 whitening ------------------------------------------------------------------


def check_whitened(rows, vectors):
    """vectors: (id, list) of the rows that take part."""
    x = np.floor(1024 * np.array([v for _, v in vectors], dtype=np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), [sum(int(v) for v in col) for col in x.T]
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    kept = [k for k in range(min(8, x.shape[1])) if values[k] > 1e-12 * values[0]]
    assert len(rows) == n * len(kept)
    exact = sorted((repr(i), sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True))) for (i, _), row in zip(vectors, x, strict=True))
    for k in kept:
        mine = [r for r in rows if r["component"] == k + 1]
        assert sorted((repr(r["vec_id"]), int(r["deviation"])) for r in mine) == exact
        assert all(r["n"] == n and r["identity_error"] <= 1e-4 and abs(r["explained"] - values[k] / values.sum()) < 1e-9 for r in mine)
    ids = [i for i, _ in vectors]
    if len(set(ids)) == n:
        # Components: whitened values are the centred vectors' projections on unit eigenvectors, over the eigenvalues' roots.
        at = {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
        w = np.array([[at[i, k + 1] for k in kept] for i in ids])
        axes = np.linalg.lstsq(centred, w, rcond=None)[0] * np.sqrt(values[kept])
        if n > x.shape[1]:
            assert np.allclose(axes.T @ axes, np.eye(len(kept)), atol=1e-8)
            assert np.allclose(cov @ axes, axes * values[kept], rtol=1e-8, atol=1e-8 * values[0])
        assert np.allclose(w.T @ w / n, np.eye(len(kept)), atol=1e-8)


def test_whitening_of_the_table(spark):
    rows = QUERIES["op11_embedding_whitening"](spark, DATA).collect()
    check_whitened(rows, [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()])


def test_whitening_of_awkward_rows(spark):
    rng = random.Random(4)
    good = [(i, [rng.gauss(0, 1) * (j + 1) for j in range(10)], i % 3) for i in range(60)] + [(None, [0.0] * 10, None), (7, [0.5] * 10, 1)]
    bad = [(90, None, 1), (91, [1.0] * 9 + [None], 1), (92, [NAN] * 10, 1), (93, [INF] + [0.0] * 9, 1), (94, [], 1), (95, [1.0] * 3, 1), (96, [3e30] * 10, 1)]
    both = good + bad
    rng.shuffle(both)
    rows = whitening.whiten(table(spark, both).repartition(5)).collect()
    check_whitened(rows, [(r[0], r[1]) for r in good])
    same = whitening.whiten(table(spark, [*good[:60], good[0], good[0]])).collect()
    check_whitened(same, [(r[0], r[1]) for r in [*good[:60], good[0], good[0]]])


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None, 1)])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0
    rows = whitening.whiten(table(spark, [(i, [float(i), 5.0], 1) for i in range(6)])).collect()  # one of two dimensions varies
    check_whitened(rows, [(i, [float(i), 5.0]) for i in range(6)])
    assert {r["component"] for r in rows} == {1}


@pytest.mark.parametrize("n", [3, 10**5, 10**9, 10**14])
def test_deviations_are_exact(n):
    rng = np.random.default_rng(n)
    x = 100_000 + rng.integers(-5000, 5000, (50, 64))
    sums = [int(v) * n // 50 + 1 for v in x.sum(axis=0)]
    assert whitening.squared_deviation(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]


def test_merging_is_pairwise_exact():
    rng = np.random.default_rng(5)
    x = rng.integers(99_000, 101_000, (1000, 6))
    cuts = [0, 1, 2, 300, 301, 999, 1000]
    merged = None
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = whitening.Moments.of(x[a:b])
        merged = part if merged is None else merged.merge(part)
    centred = x - x.mean(axis=0)
    assert merged.n == 1000 and [int(v) for v in merged.sums] == x.sum(axis=0).tolist()
    assert np.allclose(merged.scatter, centred.T @ centred, rtol=1e-12, atol=1e-6)


# --- 13 hard negatives -------------------------------------------------------------


def mined(vectors, anchors, k=5):
    """Brute force over rows (id, vector, label)."""
    rows = {(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v), label) for i, v, label in vectors}
    out = set()
    for i, x, label in rows:
        if i not in anchors:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), j, other) for j, y, other in rows if j != i]
        same = sorted(r for r in scored if r[2] == label)[:k]
        others = sorted(r for r in scored if r[2] != label)
        for s, positive, _ in same:
            fits = [r for r in others if 80 * -s <= 100 * -r[0] <= 100 * -s]
            out |= {(i, positive, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fits[:k])}
    return out


def check_mined(rows, want):
    got = [tuple(r) for r in rows]
    assert len(got) == len(set(got)) and set(got) == want


def test_hard_negatives_of_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    vectors = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in rows]
    want = mined(vectors, {i for i, _, _ in vectors if i % 100 == 0})
    assert want
    check_mined(QUERIES["op13_hard_negatives"](spark, DATA).collect(), want)


@pytest.mark.parametrize("shape", ["clusters", "ties", "few"])
def test_hard_negatives_of_awkward_rows(spark, monkeypatch, shape):
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 3)
    monkeypatch.setattr(hard_negatives, "PAIRS", 64)
    rng = random.Random(6)
    centres = [[rng.gauss(0, 2) for _ in range(7)] for _ in range(5)]
    if shape == "clusters":
        good = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % 5]], rng.randint(0, 2)) for i in range(300)]
    elif shape == "ties":  # few different vectors, many of them alike
        good = [(i, [float(x) for x in centres[0 if i % 3 else i % 4]], i % 4) for i in range(200)]
    else:  # fewer rows than asked for, anchors without a partner
        good = [(i, [rng.gauss(0, 1) for _ in range(7)], 0 if i < 8 else i) for i in range(12)]
    repeated = [good[0], good[1], (good[2][0], good[2][1], 1)]
    bad = [(900, None, 1), (901, good[0][1], None), (902, [1.0] * 6 + [None], 1), (903, [NAN] * 7, 1), (904, [INF] * 7, 1), (905, [1.0], 1), (906, [], 1), (None, good[0][1], 1)]
    both = [*good, *repeated, *bad]
    rng.shuffle(both)
    rows = hard_negatives.mine(table(spark, both).repartition(3), F.col("vec_id") % 10 == 0).collect()
    check_mined(rows, mined(good + repeated, set(range(0, 300, 10))))


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(table(spark, []), F.col("vec_id") == 1).count() == 0
    assert hard_negatives.mine(table(spark, [(1, [1.0], 1)]), F.col("vec_id") == 1).count() == 0
    assert hard_negatives.mine(table(spark, [(1, [1.0], 1), (2, [1.0], 1)]), F.col("vec_id") > 5).count() == 0


def test_bounds_hold():
    """No score lies outside the codes' sum plus and minus the bound, and the bound excludes most pairs."""
    rng = np.random.default_rng(7)
    x = np.floor(256 * rng.normal(0, 0.125, (3000, 64)))
    quantiser = hard_negatives.Quantiser(x[:1000])
    codes, slack = quantiser.codes(x)
    q = x[:50]
    rough = sum(rows[codes[:, m]] for m, rows in enumerate(quantiser.table(q)))
    edge = slack[:, None] * np.sqrt((q * q).sum(axis=1))
    exact = x @ q.T
    assert (np.abs(rough - exact) <= edge).all()
    best = np.sort(exact, axis=0)[-6]
    assert (rough + edge >= best).mean() < 0.3
