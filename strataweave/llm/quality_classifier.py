"""Quality classifier: regularised quadratic discriminant analysis.

Document statistics are transformed (logs of rates), so that their classes
look closer to normal. Each class has its own mean and a covariance shrunk
towards the pooled covariance and towards a multiple of the identity. The
score is the logistic of the difference of the classes' log densities, which
are Mahalanobis forms over Cholesky factors that are inverted once, at fitting.

Fitting reads every labelled training row through one aggregate of sums and
products (its size depends on the number of statistics alone). To score
documents, statistics are computed once and stored in the shared folder, as
both fitting and scoring read them. To filter them, the model is fitted on at
most FIT_ROWS labelled rows, those of the least hashes of their ids, as
statistics of more texts would be computed for the fit alone.

Defined results: null or empty text has the statistics of a text of no words;
rows without a label take no part in fitting; if a class has no labelled row,
every score is the share of label 1 (0.5 without labels); repeated rows are
scored alike; extra columns are left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm import quality_rules as R
from strataweave.llm import text_stats as S
from strataweave.llm.tables import boxed, stored

THRESHOLD = 0.7
#: Shares of the pooled covariance and of the identity in each class covariance.
POOLED, RIDGE = 0.1, 0.02
#: filter_documents fits on so many labelled rows at most.
FIT_ROWS = 20_000


def counts() -> dict[str, Column]:
    """What the statistics are made of, over the columns of with_words()."""
    text = F.col("_text")
    return {
        "_n": S.n_words(),
        "_c": S.word_chars(),
        "_sym": S.n_symbols(),
        "_exc": R.n_exclaims(),
        "_up": R.n_upper(),
        "_adj": S.n_adjacent_repeats(),
        "_dis": S.n_distinct_words(),
        "_dup": S.n_dup_lines(),
        "_lin": S.n_lines(),
        "_dig": S.occurrences(text, "0123456789"),
        "_pun": S.occurrences(text, ".,;:"),
    }


def statistics() -> list[Column]:
    """The transformed statistics, over the columns of counts()."""
    n = F.greatest(F.col("_n"), F.lit(1))
    c = F.greatest(F.col("_c"), F.lit(1))
    rate = lambda x, of, least: F.log(F.col(x) / of + least)
    return [
        F.log1p("_n"),
        rate("_c", n, 0.5),
        rate("_sym", n, 0.05),
        rate("_exc", n, 0.05),
        rate("_up", c, 0.02),
        rate("_adj", n, 0.05),
        # Distinct words fall with length by a power (Heaps); the exponent takes length out.
        F.log(F.greatest(F.col("_dis"), F.lit(1)) / F.pow(n, F.lit(0.93))),
        rate("_dup", F.greatest(F.col("_lin"), F.lit(1)), 0.1),
        rate("_dig", c, 0.05),
        rate("_pun", n, 0.05),
    ]


def described(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep and x, the array of statistics."""
    counted = S.with_words(docs.select(*keep, *([] if text in keep else [text])), text).select(*keep, *(c.alias(n) for n, c in counts().items()))
    return counted.select(*keep, F.array(*statistics()).alias("x"))


@dataclass(frozen=True)
class Model:
    """For each label: log prior less half the log determinant, mean, inverse Cholesky factor."""

    parts: dict[int, tuple[float, np.ndarray, np.ndarray]]
    prior: float

    def score(self, x: str = "x") -> Column:
        """The probability of label 1 as an expression over the array x."""
        if len(self.parts) < 2:
            return F.lit(float(self.prior))

        def density(label: int) -> Column:
            base, mean, factor = self.parts[label]
            square: Column = F.lit(0.0)
            for i in range(len(mean)):
                z: Column = F.lit(0.0)
                for j in range(i + 1):
                    z = z + (F.col(x)[j] - F.lit(float(mean[j]))) * F.lit(float(factor[i, j]))
                square = square + z * z
            return F.lit(float(base)) - 0.5 * square

        return 1.0 / (1.0 + F.exp(F.least(density(0) - density(1), F.lit(700.0))))


def fit(rows: DataFrame, label: str = "label", x: str = "x", pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    """rows: label (0 or 1) and x, of training rows only."""
    d = len(statistics())
    at = [(i, j) for i in range(d) for j in range(i + 1)]
    found = (
        rows.filter(F.col(label).isin(0, 1))
        .groupBy(F.col(label).cast("int").alias("label"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*(F.sum(F.col(x)[i]) for i in range(d))).alias("s"),
            F.array(*(F.sum(F.col(x)[i] * F.col(x)[j]) for i, j in at)).alias("p"),
        )
        .collect()
    )
    total = sum(r["n"] for r in found)
    moments = {}
    for r in found:
        mean = np.array(r["s"]) / r["n"]
        second = np.zeros((d, d))
        for (i, j), v in zip(at, r["p"], strict=True):
            second[i, j] = second[j, i] = v / r["n"]
        moments[r["label"]] = (r["n"], mean, second - np.outer(mean, mean))
    if len(moments) < 2:
        return Model({}, float(next(iter(moments), 0.5)))
    common = sum(n * cov for n, _, cov in moments.values()) / total
    parts = {}
    for label_, (n, mean, cov) in moments.items():
        shrunk = (1 - pooled) * cov + pooled * common + ridge * max(np.trace(common) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        parts[label_] = (math.log(n / total) - float(np.log(np.diag(lower)).sum()), mean, np.linalg.inv(lower))
    return Model(parts, moments[1][0] / total)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    described_ = stored(described(docs, [id_col], text), "statistics")
    learn = described_.filter(~held_out(id_col)).join(labels.filter(F.col(label).isNotNull()).select(id_col, F.col(label).alias("label")), id_col)
    model = fit(learn)
    scored = described_.select(id_col, held_out(id_col).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents predicted 1, with the columns they came with."""
    marked = labels.filter(F.col(label).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label).alias("_label"))
    marked = marked.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    # fit_rows ids at most, so the list may be broadcast, and no text moves.
    known = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_source")).join(F.broadcast(marked), "_id")
    model = fit(described(known, ["_label"], "_source"), "_label")
    counted = S.with_words(boxed(docs, _source=F.col(text)), "_source").select("_doc", *(c.alias(n) for n, c in counts().items()))
    return S.only(counted.withColumn("_x", F.array(*statistics())), model.score("_x") >= THRESHOLD).select("_doc.*")
