"""Quality rules whose cutoffs carry a risk guarantee.

Each document gets counts over its whole text, and from them a few *rule
values* (higher is worse). Labelled holdout rows (``labels.quality``) decide
how far the rules may cut in a stratum (language). All rules share one fixed
sequence of steps, each of which tightens one rule's cutoff (the loosest
cutoffs of all rules first). A step is accepted while the exact binomial
(Clopper-Pearson) upper bound on the share of good documents that the cutoffs
so far reject *together* stays below ``RISK``; the first failure ends the
sequence. Fixed-sequence testing needs no correction inside a sequence, and the
error rate is divided over the strata that have holdout rows enough to accept
anything (Bonferroni; the others cannot err, see ``testable``). With
probability ``1 - ERROR`` over the holdout, no stratum loses more than
``RISK`` of its good documents to the learned rules. A stratum without enough
holdout rows gets no cutoff, so it rejects nothing.

Every stratum is judged by its own holdout rows only, however many strata
there are: the cutoffs stay a distributed table, joined by stratum.

Defined results: a text that is null or empty has no words and fails the base
rule; null languages are one stratum; strata without labelled good rows meet
the base rule only; repeated ids are
kept row by row (a label counts once for each row of its id); an empty
documents or labels table gives no cutoffs; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize

RISK = 0.04
ERROR = 0.05
#: rule -> (numerator, denominator): values are ratios, higher is worse
RULES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
         "repeats": ("n_repeat_words", "n_words"), "long_words": ("word_chars", "n_words")}
#: ladder of cutoffs for each rule, loosest first
LADDER = {"symbols": [2.0 * 0.85 ** i for i in range(40)], "dup_lines": [0.9 * 0.9 ** i for i in range(30)],
          "repeats": [0.3 * 0.9 ** i for i in range(30)], "long_words": [40.0 * 0.95 ** i for i in range(40)]}
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
_BLANK = re.compile(r"[ \t\n\x0b\x0c\r]*\Z")


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a ``window`` of words found twice or more.

    Windows are compared exactly: words are numbered, then pairs of numbers
    are numbered, and so on (``window`` is a power of two)."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    step = 1
    while step < window:
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    again = np.bincount(ids)[ids] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)``."""
    text = text or ""
    data = text.encode()
    words = data.split()
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if not _BLANK.match(line):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (len(words), len(text) - (len(data) - len(data.translate(None, SPACE))),
            len(data) - len(data.translate(None, SYMBOLS)), dup, repeated_words(words), lines)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The counts of every document: ``(id, stratum, <COUNTS>, base_failed)``."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(stratum_col).cast("string").alias("stratum"),
                      F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([measure(t) for t in pdf["text"]], columns=COUNTS, dtype="int64")
            yield pd.concat([pdf[["id", "stratum"]].reset_index(drop=True), got], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    out = src.mapInPandas(run, "id string, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    out = out.withColumn("id", F.col("id").cast(kind))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def rule_value(rule: str) -> Column:
    top, below = RULES[rule]
    return F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(F.lit(0.0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly summed."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    lg = np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i])
    return float(np.exp(math.lgamma(n + 1) - lg + i * math.log(p) + (n - i) * math.log1p(-p)).sum())


def accepted_cutoff(ladder: list[float], false_rejections: list[int], n: int, risk: float, error: float) -> float | None:
    """The tightest cutoff before the first whose upper confidence bound on
    the rejection rate exceeds ``risk`` (bound <= risk exactly when
    P(X <= k | risk) <= error)."""
    best = None
    for cut, k in zip(ladder, false_rejections):
        if n == 0 or k > n * risk or binomial_tail(k, n, risk) > error:
            break
        best = cut
    return best


def testable(sizes: list[tuple[int, int]], risk: float, error: float) -> int:
    """Among how many strata the error is divided: the least ``m`` such that
    at most ``m`` strata have the rows that ``error / m`` asks for when none is
    rejected. Smaller strata can accept nothing then, so they cannot err.
    ``sizes``: (rows, how many strata have that many)."""
    def able(m: int) -> int:
        return sum(c for n, c in sizes if n * math.log1p(-risk) <= math.log(error / m) + 1e-9)
    lo, hi = 1, max(1, sum(c for _, c in sizes))
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if able(mid) <= mid else (mid + 1, hi)
    return lo


#: The steps ``(position in the ladder, rule)`` in the order of testing.
STEPS = sorted(((i, r) for r in RULES for i in range(len(LADDER[r]))), key=lambda s: (s[0], list(RULES).index(s[1])))


def first_step() -> Column:
    """The first step whose cutoff rejects a row (null: none does)."""
    def of(rule: str) -> Column:
        passed = sum(((rule_value(rule) <= F.lit(c)).cast("int") for c in LADDER[rule]), F.lit(0))
        return F.get(F.array(*[F.lit(STEPS.index((i, rule))) for i in range(len(LADDER[rule]))]), passed)
    return F.least(*[of(r) for r in RULES])


def accepted_cutoffs(rejected: dict[int, int], n: int, risk: float, error: float) -> list[float | None]:
    """The cutoff of each rule after the last accepted step, where of ``n``
    good rows ``rejected[s]`` are first rejected by step ``s``."""
    together = np.cumsum([rejected.get(s, 0) for s in range(len(STEPS))]).tolist()
    last = accepted_cutoff(list(range(len(STEPS))), together, n, risk, error)
    tight = {r: LADDER[r][i] for i, r in STEPS[:0 if last is None else last + 1]}
    return [tight.get(r) for r in RULES]


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
            risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Cutoffs ``(stratum, <a column for each rule>)``; a rule that no
    accepted step has tightened has null, a stratum without any cutoff has no
    row."""
    good = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("label = 1 and id is not null")
    held = measured.filter(~F.col("base_failed")).join(good.select("id"), "id")
    steps = held.withColumn("step", first_step()).groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("k"))
    # a row for each stratum, with at most a pair for each step
    table = materialize(steps.groupBy("stratum").agg(F.sum("k").alias("n"), F.collect_list(F.struct("step", "k")).alias("steps")),
                        "quality-steps")
    # strata with more rows than MANY are testable at any number of strata
    # below 1e18, so at most MANY sizes are told apart
    many = math.ceil(math.log(error / 1e18) / math.log1p(-risk))
    sizes = table.groupBy(F.least("n", F.lit(many)).alias("n")).count().collect()
    m = testable([(r["n"], r["count"]) for r in sizes], risk, error)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for stratum, n, pairs in zip(pdf["stratum"], pdf["n"], pdf["steps"]):
                rejected = {int(p["step"]): int(p["k"]) for p in pairs if p["step"] is not None}
                cut = accepted_cutoffs(rejected, int(n), risk, error / m)
                if any(c is not None for c in cut):
                    rows.append((stratum, *cut))
            got = pd.DataFrame(rows, columns=["stratum", *RULES])
            yield got.astype({r: "float64" for r in RULES})

    return table.mapInPandas(decide, "stratum string, " + ", ".join(f"{r} double" for r in RULES))


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``kept``: the base rule holds and no value exceeds the cutoff of its
    own stratum in ``cuts`` (see ``cutoffs``)."""
    cuts = cuts.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in RULES])
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(rule_value(r) > F.col(f"_{r}"), F.lit(False))
    both = measured.join(cuts, measured["stratum"].eqNullSafe(cuts["_stratum"]), "left")
    return both.withColumn("kept", ~F.col("base_failed") & ~bad).select(*measured.columns, "kept")


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Counts and verdict of every document (see the module's text)."""
    # measured once: the holdout and the verdicts both read the stored counts
    measured = materialize(counts(docs, id_col, text_col, stratum_col), "quality-counts")
    cuts = materialize(cutoffs(measured, labels, id_col, label_col), "quality-cutoffs")
    return judge(measured, cuts).withColumnRenamed("id", id_col).withColumnRenamed("stratum", stratum_col)

