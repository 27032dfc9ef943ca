"""Rule-based quality filter as a short-circuit cascade [native].

Every rule is a Boolean expression that is true for documents to reject, with
one for its work on a document: the characters or words that it goes through,
times what one of them costs. In one job over a sample of about SAMPLE_ROWS
documents the planner estimates each rule's cost and how often it rejects, then
orders the rules by rejection per cost, so that a cheap rule that rejects much
runs first; a CASE then stops at the first rule that rejects. Work is counted
rather than timed, so that the same documents give the same order whatever else
the machines do. The order changes the work only: a document is kept if no rule
rejects it, in whatever order.

Defined results: null text counts as empty and fails the length rule; an
empty table gives an empty result; repeated rows are judged row by row; extra
columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm import text_stats as S
from strataweave.llm.tables import boxed

#: The planner's sample holds about so many documents, whatever the input's size.
SAMPLE_ROWS = 3000


def characters(nanoseconds: float) -> Callable[[], Column]:
    return lambda: F.octet_length("_text") * nanoseconds


def words(nanoseconds: float) -> Callable[[], Column]:
    return lambda: F.size("_words") * nanoseconds


@dataclass(frozen=True)
class Rule:
    """reject builds an expression over the columns of prepared(), which
    stands alone in a CASE: nothing of it is computed before its turn. work
    gives its nanoseconds on a document, as measured once on invented prose."""

    name: str
    reject: Callable[[], Column]
    work: Callable[[], Column] = lambda: F.lit(20.0)


def n_exclaims() -> Column:
    return S.occurrences(F.col("_text"), "!")


def n_upper() -> Column:
    return F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long")


BASE_RULES = (
    Rule("too_short", lambda: S.n_words() < 20),
    Rule("repetitive", lambda: 100 * S.n_repeat_words() > 30 * S.n_words(), words(320)),
)
OWN_RULES = (
    Rule("symbols", lambda: 10 * S.n_symbols() > S.n_words(), characters(60)),
    Rule("shouting", lambda: 10 * n_upper() > 4 * S.word_chars(), characters(44)),
    Rule("exclaims", lambda: 10 * n_exclaims() > 3 * S.n_words(), characters(10)),
    Rule("stutter", lambda: 10 * S.n_adjacent_repeats() > 2 * S.n_words(), words(320)),
    Rule("same_lines", lambda: 10 * S.n_dup_lines() > 5 * S.n_lines(), characters(33)),
    Rule("word_length", lambda: S.let(S.word_chars(), lambda n: (n < 2 * S.n_words()) | (n > 25 * S.n_words())), characters(20)),
)
RULES = BASE_RULES + OWN_RULES
FIGURES = {"n_words": S.n_words, "word_chars": S.word_chars, "n_symbols": S.n_symbols, "n_dup_lines": S.n_dup_lines, "n_repeat_words": S.n_repeat_words}


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns that rules read."""
    return S.with_words(docs, text).withColumn("_windows", S.windows())


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost_ns: float
    rejection: float

    @property
    def rank(self) -> float:
        return self.rejection / max(self.cost_ns, 1.0)


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Measured]:
    """Rules by rejection per cost, best first; ties keep the given order."""
    total = docs.count()
    # The sample is dealt over all tasks, so long texts don't meet in one; a row of sums comes from each.
    drawn = docs.select(text).sample(fraction=min(1.0, rows / max(total, 1)), seed=seed)
    sample = prepared(drawn.repartition(docs.sparkSession.sparkContext.defaultParallelism), text)
    sums = [F.sum(x).alias(f"{n}{i}") for i, r in enumerate(rules) for n, x in (("cost", r.work()), ("hits", r.reject().cast("int")))]
    seen = sample.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    measured = [Measured(r, (seen[f"cost{i}"] or 0) / max(seen["n"], 1), (seen[f"hits{i}"] or 0) / max(seen["n"], 1)) for i, r in enumerate(rules)]
    return sorted(measured, key=lambda m: -m.rank)


def passes(order: list[Rule]) -> Column:
    """True for documents that no rule rejects; stops at the first that does."""
    verdict = F.lit(True)
    for rule in reversed(order):
        verdict = F.when(rule.reject(), F.lit(False)).otherwise(verdict)
    return verdict


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    order = [m.rule for m in plan(docs, rules, text)]
    return S.only(prepared(boxed(docs, _source=F.col(text)), "_source"), passes(order)).select("_doc.*")


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its base figures and verdicts.

    The base figures are wanted for every row, so they are computed once; the
    cascade then runs over the other rules, and only for rows that pass the base.
    """
    order = [m.rule for m in plan(docs, OWN_RULES, text)]
    figures = prepared(docs.select(id_col, text), text).withColumns({n: f() for n, f in FIGURES.items()})
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return figures.withColumn("base_failed", failed).select(
        id_col, *FIGURES, "base_failed", F.when(F.col("base_failed"), F.lit(False)).otherwise(passes(order)).alias("kept")
    )
