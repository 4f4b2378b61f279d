"""Toxic passages by maximum-scoring segments.

Training counts in how many toxic and clean labelled documents each *token*
stands: words and their beginnings (``STEMS`` characters), which carry a stem
through its endings. A document counts once, however often it repeats itself. Each gets a log-odds ratio under an informative Dirichlet prior (the
corpus frequencies, worth ``PRIOR`` times the toxic words), with its z-value.
Tokens with clear and strong evidence (``MIN_Z``, and ``MIN_LOG_ODDS`` before
the prior, whatever the share of toxic rows) keep their log-odds as score; a word
scores as the best of its tokens and costs ``DRIFT`` when it has none. A
linear-time scan (Ruzzo and Tompa) finds all maximal-scoring
segments of a text. Their scores follow an extreme-value law: ``lambda`` solves
``sum p_i exp(lambda s_i) = 1`` over the clean word frequencies and ``K`` is
fitted on clean training documents, so a segment of score ``S`` in a text of
``n`` words has normalised score ``lambda S - ln(K n)`` and E-value
``exp(-that)``. A text's evidence adds the normalised scores of its
significant segments (E-value up to ``MAX_E``; else the best one counts), and
a logistic calibration on the training rows turns it into the score.

Labels are read only for training rows; label, language, source and id never
enter a score. Training uses at most ``MAX_TRAIN`` labelled rows, the lowest
by a hash of the id, and at most ``MAX_WORDS`` scored words, the highest by
z-value; both bound what is broadcast.

Defined results: null or empty text has no segment and gets the score of no
evidence; null or repeated ids are scored row by row; without both labels
among the training rows every score is 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import give_back, materialize

PRIOR = 1.0
MIN_Z = 3.3
#: Least log-odds ratio of the counts themselves; weaker tokens mostly tell
#: languages or topics with more toxic rows apart. The prior shrinks what a
#: token can reach to ln((1 + f) / 2f^2) for a toxic share f of the words, so a
#: cutoff on the shrunk ratio would lock every token out of balanced labels.
MIN_LOG_ODDS = 2.67
STEMS = (4, 5, 6)
DRIFT = 0.05
MAX_E = 0.05
MAX_TRAIN = 60_000
MAX_WORDS = 20_000
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def tokens(word: str) -> list[str]:
    """The word and, marked by ``*``, its beginnings."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def maximal_segments(at: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last word, score)`` of a text
    whose words at ``at`` score ``score`` and all others ``-drift``.

    Ruzzo and Tompa's scan over the positive words only; the cumulative score
    just before a word includes the drift of the words passed over."""
    out: list[list[float]] = []  # first, last, cumulative before, cumulative after, link
    total, prev = 0.0, -1
    for p, s in zip(at, score):
        total -= drift * (p - prev - 1)
        left, right = total, total + s
        total, prev = right, p
        new = [p, p, left, right, -1]
        j = len(out) - 1
        while True:
            # the nearest segment that starts lower: segments between a
            # segment and its link start no lower than it does
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= new[3]:
                break
            new = [out[j][0], new[1], out[j][2], new[3], -1]
            del out[j + 1:]
            j = out.pop()[4]
        new[4] = j
        out.append(new)
    return [(int(a), int(b), r - l) for a, b, l, r, _ in out]


class Model:
    """Scores of words and the laws that turn segments into a probability."""

    def __init__(self, scores: dict[str, float], lam: float, log_k: float, drift: float = DRIFT,
                 a: float = 0.0, b: float = -30.0):
        self.scores, self.lam, self.log_k, self.drift, self.a, self.b = scores, lam, log_k, drift, a, b
        self.known: dict[str, float] = {}  # scores of words met before

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        ws = words(text)
        if len(self.known) > 150_000:
            self.known.clear()
        get = self.scores.get
        for w in set(ws):
            if w not in self.known:
                self.known[w] = max([get(t, 0.0) for t in tokens(w)])
        hits = [(i, s) for i, s in enumerate(map(self.known.__getitem__, ws)) if s > 0]
        return len(ws), maximal_segments([i for i, _ in hits], [s for _, s in hits], self.drift)

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Segments with their normalised scores, in order."""
        n, segs = self.segments(text)
        return [(a, b, self.lam * s - self.log_k - math.log(max(n, 1))) for a, b, s in segs]

    def evidence(self, passages: list[tuple[int, int, float]]) -> float:
        """Sum over significant passages, or the best one's score (never
        below that of no passage)."""
        least = -math.log(MAX_E)
        good = [s for _, _, s in passages if s >= least]
        return sum(good) if good else max([-5.0, *(s for _, _, s in passages)])

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * evidence + self.b, -30, 30)))


def solve_lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of ``sum p exp(lambda s) = 1`` (bisection)."""
    f = lambda x: float((p * np.exp(np.clip(x * s, -700, 700))).sum()) - 1
    lo, hi = 1e-6, 1e-3
    while f(hi) < 0 and hi < 100:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str, label_col: str,
                  max_train: int) -> DataFrame:
    """``(text, label)`` of at most ``max_train`` usable labelled rows."""
    lab = (labels.filter(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
           .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
           .orderBy(F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)).limit(max_train))
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return d.join(F.broadcast(lab), "_id").select("text", "label")  # at most max_train narrow rows


def train(rows: DataFrame, prior: float = PRIOR, min_z: float = MIN_Z, max_words: int = MAX_WORDS) -> Model:
    """A model from ``(text, label)`` rows."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for pdf in batches:
            for t, y in zip(pdf["text"], pdf["label"]):
                (toxic if y == 1 else clean).update({x for w in set(words(t)) for x in tokens(w)})
            if len(toxic) + len(clean) > 500_000:
                yield frame(toxic, clean)
                toxic.clear()
                clean.clear()
        if toxic or clean:
            yield frame(toxic, clean)
        toxic.clear()
        clean.clear()
        give_back()

    def frame(toxic: Counter, clean: Counter) -> pd.DataFrame:
        ws = list(toxic.keys() | clean.keys())
        return pd.DataFrame({"w": ws, "t": [toxic[w] for w in ws], "c": [clean[w] for w in ws]})

    tab = (rows.mapInPandas(count, "w string, t long, c long").groupBy("w")
           .agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    tab = materialize(tab, "toxicity-tokens")
    n = tab.filter("w not like '%*'").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    nt, nc = float(n["t"] or 0), float(n["c"] or 0)
    if not nt or not nc:
        return Model({}, 1.0, 0.0)
    prior = prior * nt
    al = F.col("p") * F.lit(prior)
    lo = lambda y, tot: F.log((F.col(y) + al) / (F.lit(tot + prior) - F.col(y) - al))
    plain = lambda y, tot: F.log((F.col(y) + 0.5) / (F.lit(tot + 0.5) - F.col(y)))
    z = (tab.filter("t > 1").withColumn("p", (F.col("t") + F.col("c")) / F.lit(nt + nc))
         .withColumn("s", lo("t", nt) - lo("c", nc))
         .withColumn("z", F.col("s") / F.sqrt(1 / (F.col("t") + al) + 1 / (F.col("c") + al)))
         .filter((F.col("z") >= min_z) & (plain("t", nt) - plain("c", nc) >= MIN_LOG_ODDS)).orderBy(F.col("z").desc(), "w").limit(max_words).collect())
    scores = {r["w"]: float(r["s"]) for r in z}
    if not scores:
        return Model({}, 1.0, 0.0)
    # frequencies of the scores in clean text, half a count where none was seen
    p = np.array([max(float(r["c"]), 0.5) / nc for r in z])
    s = np.array([float(r["s"]) for r in z])
    p = p / max(1.0, 2 * p.sum())  # a word's tokens are counted one by one
    drift = max(DRIFT, 2 * float((p * s).sum()))  # the mean score must be negative
    lam = solve_lambda(np.append(p, 1 - p.sum()), np.append(s, -drift))
    model = Model(scores, lam, 0.0, drift)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for t, y in zip(pdf["text"], pdf["label"]):
                k, segs = model.segments(t)
                if y == 0 and segs and k:
                    got.append(lam * max(x[2] for x in segs) - math.log(k))
            yield pd.DataFrame({"x": got}, dtype="float64")
        model.known.clear()
        give_back()

    # Gumbel: the mean of lambda * S - ln n lies Euler's constant above ln K
    m = rows.mapInPandas(best, "x double").agg(F.avg("x").alias("m")).first()["m"]
    model.log_k = float(m) - 0.5772156649 if m is not None else 0.0

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e = [round(model.evidence(model.passages(t)), 1) for t in pdf["text"]]
            yield pd.DataFrame({"e": np.minimum(e, 60.0), "label": pdf["label"]})
        model.known.clear()
        give_back()

    ev = (rows.mapInPandas(evidence, "e double, label int").groupBy("e")
          .agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).collect())  # e: 650 steps of 0.1
    model.a, model.b = logistic(np.array([[r["e"], r["t"], r["c"]] for r in ev], float))
    return model


def logistic(x: np.ndarray) -> tuple[float, float]:
    """Logistic fit of rows ``(evidence, toxic, clean)`` by Newton steps."""
    ab = np.array([0.5, -2.0])
    f = np.stack([x[:, 0], np.ones(len(x))], axis=1)
    n = x[:, 1] + x[:, 2]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(f @ ab, -30, 30)))
        h = (f * (n * p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(h, f.T @ (n * p - x[:, 1]) + 1e-3 * ab), -2, 2)
    return max(0.0, float(ab[0])), float(ab[1])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label may not be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, score, passages)``; a passage is ``(first, last,
    normalised)`` in words, significant ones only."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = -math.log(MAX_E)
        for pdf in batches:
            found = [model.passages(t) for t in pdf["text"]]
            e = np.minimum([model.evidence(p) for p in found], 60.0) if len(found) else np.zeros(0)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "score": model.probability(np.asarray(e, float)),
                                "passages": [[{"first": a, "last": b, "normalised": s} for a, b, s in p if s >= least]
                                             for p in found]})
        model.known.clear()
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInPandas(run, "id string, score double, passages array<struct<first:int,last:int,normalised:double>>") \
        .withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_train: int = MAX_TRAIN) -> Model:
    """Train on the labelled rows that are not held out."""
    rows = training_rows(docs, labels, ~held_out(id_col), id_col, text_col, label_col, max_train)
    return train(materialize(rows, "toxicity-training"))
