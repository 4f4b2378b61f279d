"""Secret scan: fixed rules plus a character convolutional network.

One pass over the whole texts finds the *base* spans (three fixed patterns,
leftmost, non-overlapping per kind) and the *candidates*: every run of 16 or
more token characters that no base span touches, cut into windows of the run
with the characters around it. The result is stored once. A small numpy
network (one-hot character classes, one convolution, max and mean pooling) is
trained on labelled windows: those over base findings are positive, those
over runs made of a text's own short words negative (no secret by
construction). The candidates themselves are what is judged and take no part.
Half of the training windows lose their context and some change case, so that
the net judges the token's own shape too. A logistic calibration and the
threshold come from a held-out part: the highest threshold up to
``MAX_THRESHOLD`` that keeps ``MIN_RECALL`` of its findings.
Candidates whose best window passes are added as spans of kind ``net``.

The training sample is bounded: the ``MAX_FINDINGS`` positive and as many
negative windows lowest by a hash. Always added are ``SYNTHETIC`` generated
keys and as many generated runs of other kinds (``synthetic``), so a net is
trained whatever the corpus holds.

Defined results: null or empty text has no spans; rows with null or repeated
ids are scanned one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize

#: The base patterns, in the order of their kinds.
KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in KEYWORDS)
                    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "net"]

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A short word of letters, no part of a longer run of token characters.
PLAIN = re.compile(r"(?<![\w+/=-])[A-Za-z]{2,15}(?![\w+/=-])")
PLAIN_REACH = 600
BEFORE, BODY, AFTER = 16, 40, 8
WIDTH = BEFORE + BODY + AFTER
MAX_FINDINGS = 3000
SYNTHETIC = 600
MIN_RECALL = 0.95
#: Held-out findings resemble the training ones: however sure the net is of
#: them, a threshold above this would ask more of a new kind of secret.
MAX_THRESHOLD = 0.9

#: character -> class of the one-hot input; 0 is padding
_CLASSES = ["abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/", "_-", ".", "=", "\"'`",
            ":", " \t", "\n\r", "aeiou"]
N_CLASS = len(_CLASSES) + 2
_OTHER = N_CLASS - 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Base spans ``(start, end, kind)``, ends exclusive, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def windows(text: str, start: int, end: int) -> list[str]:
    """Windows over ``text[start:end]`` with their context, padded by NUL."""
    out = []
    for at in range(start, end, BODY):
        stop = min(end, at + BODY)
        left, right = text[max(0, at - BEFORE):at], text[stop:stop + AFTER]
        out.append(left.rjust(BEFORE, "\0") + text[at:stop].ljust(BODY, "\0") + right.ljust(AFTER, "\0"))
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of token characters that no base span touches."""
    out, i = [], 0
    ends = sorted((a, b) for a, b, _ in base)
    for m in CANDIDATE.finditer(text):
        while i < len(ends) and ends[i][1] <= m.start():
            i += 1
        if not any(a < m.end() and b > m.start() for a, b in ends[i:i + 4]):
            out.append((m.start(), m.end()))
    return out


def joined(ws: list[str], rng: random.Random) -> str:
    """A run of 16 characters or more made of words, in one of the ways that
    names, paths and compounds are written."""
    sep, out = rng.choice(["", "", "", "-", "_", "/"]), rng.choice(ws)
    while len(out) < 16:
        w = rng.choice(ws)
        out += sep + (w.capitalize() if sep == "" and rng.random() < 0.3 else w)
    return out


def plain_windows(text: str, base: list[tuple[int, int, str]], cand: list[tuple[int, int]]) -> list[str]:
    """At most one window over a run made of the text's short words, at the
    place of one of them. Words are taken from ``PLAIN_REACH`` characters at a
    place that depends on the text alone; words in base spans are left out, and
    so are places whose context holds part of a span or a candidate."""
    seed = zlib.crc32(text.encode("utf-8", "replace"))
    lo = seed % max(1, len(text) - PLAIN_REACH)
    found = [m for m in PLAIN.finditer(text, lo, lo + PLAIN_REACH)
             if not any(a < m.end() and b > m.start() for a, b, _ in base)]
    marked = [(a, b) for a, b, _ in base] + cand
    places = [m for m in found if not any(a < m.end() + AFTER and b > m.start() - BEFORE for a, b in marked)]
    if len(found) < 3 or not places:
        return []
    rng = random.Random(seed)
    at, run = rng.choice(places), joined([m.group() for m in found], rng)
    near = text[max(0, at.start() - BEFORE):at.start()]
    return windows(near + run + text[at.end():at.end() + BODY + AFTER], len(near), len(near) + len(run))[:1]


def synthetic(n: int = SYNTHETIC, seed: int = 3) -> tuple[list[str], list[str]]:
    """Windows over ``n`` generated keys (hexadecimal, base 32, base 62 and
    base 64, some behind a short prefix) and over ``n`` runs that are no
    secrets (joined words, numbers, dates, rules and repeated characters),
    each between generated words."""
    rng = random.Random(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    sets = [digits + "abcdef", digits + "ABCDEF", lower.upper() + "234567", lower.upper() + digits, lower + digits,
            lower + lower.upper() + digits, lower + lower.upper() + digits + "+/", lower + lower.upper() + digits + "-_"]
    parts = ["ba", "con", "de", "er", "ing", "ka", "lo", "men", "na", "ou", "per", "ri", "schen", "st", "ta", "tion", "ur", "ver"]

    def word() -> str:
        return "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))

    def key() -> str:
        body = "".join(rng.choices(rng.choice(sets), k=rng.randint(20, 64)))
        return rng.choice(["", "", "", "ghp_", "sk_live_", "xoxb-", "AKIA"]) + body + rng.choice(["", "", "", "="])

    def other() -> str:
        kind = rng.randrange(8)
        if kind < 4:
            run = joined([word() for _ in range(4)], rng)
            return run.upper() if rng.random() < 0.15 else run
        if kind == 4:
            return "".join(rng.choices(digits, k=rng.randint(16, 24)))
        if kind == 5:
            return f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}{rng.choice('-_/')}{word()}{rng.choice('-_/')}{rng.randint(0, 99999):05}"
        return rng.choice("=-_" + lower + lower.upper() + digits) * rng.randint(16, 200)

    def window(run: str) -> str:
        quote = rng.choice(["", "", '"', "'"])
        before = rng.choice([f"{word()} {word()} ", f"{word()}: ", f"{word()} = ", ""]) + quote
        text = before + run + quote + rng.choice([" ", ". ", "\n", ""]) + word()
        return rng.choice(windows(text, len(before), len(before) + len(run)))

    return [window(key()) for _ in range(n)], [window(other()) for _ in range(n)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, findings, plain, candidates)`` of every row: base spans,
    one window for each, a window that holds no secret, and the candidates with
    their windows."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            base, found, plain, cand = [], [], [], []
            for t in pdf["text"]:
                t = t or ""
                b = base_spans(t)
                base.append([{"start": x, "end": y, "kind": k} for x, y, k in b])
                found.append([w for x, y, k in b for w in windows(t, value_start(t, x, y, k), y)[:1]])
                c = candidates(t, b)
                plain.append(plain_windows(t, b, c))
                cand.append([{"start": x, "end": y, "windows": windows(t, x, y)} for x, y in c])
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "base": base, "findings": found, "plain": plain, "candidates": cand})

    return src.mapInPandas(run, "id string, base array<struct<start:int,end:int,kind:string>>, "
                                "findings array<string>, plain array<string>, candidates array<struct<start:int,end:int,windows:array<string>>>")


def value_start(text: str, start: int, end: int, kind: str) -> int:
    """Where the secret itself begins (behind the key of an assignment)."""
    return ASSIGN.match(text, start, end).start(2) if kind == "assign" else start


# ------------------------------------------------------------------- network

def class_table() -> np.ndarray:
    t = np.full(128, _OTHER, np.uint8)
    t[0] = 0
    for i, chars in enumerate(_CLASSES[:-1]):
        for c in chars:
            t[ord(c)] = i + 1
    return t


def encode(ws: list[str]) -> np.ndarray:
    """Character classes ``(n, WIDTH)``; a vowel also carries the last class
    in the second plane of ``one_hot``."""
    codes = np.frombuffer("".join(ws).encode("utf-32-le"), "<u4").reshape(len(ws), WIDTH)
    return np.where(codes < 128, class_table()[np.minimum(codes, 127)], _OTHER).astype(np.uint8) \
        + (np.isin(codes, [ord(c) for c in "aeiouAEIOU"]) * np.uint8(32))


def one_hot(x: np.ndarray) -> np.ndarray:
    out = np.zeros((*x.shape, N_CLASS), np.float32)
    np.put_along_axis(out, (x & 31)[..., None].astype(np.int64), 1.0, axis=2)
    out[..., _OTHER - 1] = (x & 32) > 0
    out[..., 0] = 0
    return out


class Net:
    """Convolution over ``k`` characters, ReLU, max and mean pooling, logit."""

    k, filters = 5, 24

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = (rng.normal(0, 0.2, (self.k * N_CLASS, self.filters))).astype(np.float32)
        self.b = np.zeros(self.filters, np.float32)
        self.v = (rng.normal(0, 0.2, 2 * self.filters)).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _columns(self, x: np.ndarray) -> np.ndarray:
        h = one_hot(x)
        return np.concatenate([h[:, i:WIDTH - self.k + 1 + i] for i in range(self.k)], axis=2)

    def forward(self, x: np.ndarray):
        cols = self._columns(x)
        a = np.maximum(cols @ self.w + self.b, 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(axis=1)], axis=1)
        return pooled @ self.v + self.c[0], (cols, a, top, pooled)

    def logits(self, ws: list[str], step: int = 512) -> np.ndarray:
        parts = [self.forward(encode(ws[i:i + step]))[0] for i in range(0, len(ws), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def probability(self, ws: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(ws).astype(float) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the logistic loss; both labels weigh the same."""
        rng = np.random.default_rng(seed)
        params = [self.w, self.b, self.v, self.c]
        m, s, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
                z, (cols, a, top, pooled) = self.forward(x[part])
                g = ((1 / (1 + np.exp(-z)) - y[part]) * weight[part] / len(part)).astype(np.float32)
                gp = g[:, None] * self.v
                ga = np.broadcast_to(gp[:, None, self.filters:] / a.shape[1], a.shape).copy()
                np.put_along_axis(ga, top[:, None], np.take_along_axis(ga, top[:, None], 1) + gp[:, None, :self.filters], 1)
                ga *= a > 0
                flat = ga.reshape(-1, self.filters)
                grads = [cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(0), pooled.T @ g, g.sum(keepdims=True)]
                t += 1
                for p, d, mi, si in zip(params, grads, m, s):
                    mi += 0.1 * (d - mi)
                    si += 0.001 * (d * d - si)
                    p -= rate * (mi / (1 - 0.9 ** t)) / (np.sqrt(si / (1 - 0.999 ** t)) + 1e-7)

    def calibrate(self, z: np.ndarray, y: np.ndarray, min_recall: float, made: np.ndarray | None = None) -> None:
        """Platt scaling by Newton steps, then the threshold by recall: it
        keeps ``min_recall`` of the findings, and of those ``made`` up too."""
        target = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
        ab = np.array([1.0, 0.0])
        f = np.stack([z.astype(float), np.ones(len(z))], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ ab, -30, 30)))
            h = (f * (p * (1 - p))[:, None]).T @ f + 0.1 * np.eye(2)
            ab = ab - np.clip(np.linalg.solve(h, f.T @ (p - target) + 0.1 * (ab - [1.0, 0.0])), -0.5, 0.5)
        self.scale, self.shift = max(0.01, float(ab[0])), float(ab[1])
        p = 1 / (1 + np.exp(-np.clip(self.scale * z.astype(float) + self.shift, -30, 30)))
        made = np.zeros(len(y), bool) if made is None else made
        self.threshold = MAX_THRESHOLD
        for q in (np.sort(p[(y == 1) & ~made]), np.sort(p[(y == 1) & made])):
            if len(q):
                self.threshold = min(self.threshold, float(q[int((1 - min_recall) * len(q))]))


def augment(ws: list[str], seed: int = 5) -> list[str]:
    """Half of the windows without context; a quarter in upper case."""
    rng, out = np.random.default_rng(seed), []
    for w, a, b in zip(ws, rng.random(len(ws)), rng.random(len(ws))):
        w = "\0" * BEFORE + w[BEFORE:BEFORE + BODY] + "\0" * AFTER if a < 0.5 else w
        out.append(w[:BEFORE] + w[BEFORE:BEFORE + BODY].upper()[:BODY] + w[BEFORE + BODY:] if b < 0.25 and w.isascii() else w)
    return out


def train(scanned: DataFrame, max_findings: int = MAX_FINDINGS) -> Net:
    """A calibrated net from a bounded sample of the scan's labelled windows
    and the synthetic ones."""
    def sample(col: str) -> list[str]:
        d = scanned.select(F.explode(col).alias("w")).distinct().withColumn("h", F.xxhash64("w"))
        return [r["w"] for r in d.orderBy("h", "w").limit(max_findings).collect()]

    p, n = sample("findings"), sample("plain")
    more, less = synthetic()
    ws = p + n + more + less
    y = np.array([1] * len(p) + [0] * len(n) + [1] * len(more) + [0] * len(less))
    made = np.arange(len(ws)) >= len(p) + len(n)
    held = np.arange(len(ws)) % 10 >= 7
    fit_ws = [w for w, h in zip(ws, held) if not h]
    net = Net()
    net.fit(encode(fit_ws + augment(fit_ws)), np.concatenate([y[~held]] * 2).astype(np.float32))
    rest = [w for w, h in zip(ws, held) if h]
    net.calibrate(net.logits(rest + augment(rest)), np.concatenate([y[held]] * 2), MIN_RECALL, np.concatenate([made[held]] * 2))
    return net


def all_spans(text: str, net: Net | None) -> list[tuple[int, int]]:
    """Base spans and the candidates that the net accepts."""
    base = base_spans(text)
    out = [(a, b) for a, b, _ in base]
    cand = candidates(text, base) if net is not None else []
    if cand:
        ws = [windows(text, a, b) for a, b in cand]
        p = net.probability([w for x in ws for w in x])
        at = 0
        for (a, b), x in zip(cand, ws):
            if p[at:at + len(x)].max() >= net.threshold:
                out.append((a, b))
            at += len(x)
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, base, spans)`` of every row as arrays of ``(start, end,
    kind)``: the base spans, and those together with the net's."""
    scanned = materialize(scan(docs, id_col, text_col), "secret-candidates")
    net = train(scanned)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ws, at = [], []
            for i, cs in enumerate(pdf["candidates"]):
                for c in cs:
                    ws += list(c["windows"])
                    at += [(i, c["start"], c["end"])] * len(c["windows"])
            hit: dict[int, set] = {}
            if ws and net is not None:
                for j in np.flatnonzero(net.probability(ws) >= net.threshold):
                    hit.setdefault(at[j][0], set()).add(at[j][1:])
            spans = []
            for i, b in enumerate(pdf["base"]):
                more = [{"start": s, "end": e, "kind": "net"} for s, e in hit.get(i, ())]
                both = [dict(x) for x in b] + more
                spans.append(sorted(both, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "base": [[dict(x) for x in b] for b in pdf["base"]], "spans": spans})

    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<start:int,end:int,kind:string>>"
    return (scanned.select("id", "base", "candidates").mapInPandas(add, f"id string, base {spans}, spans {spans}")
            .withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans of ``find_secrets``."""
    def text(col: str):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                   s["end"].cast("string"))), ",")

    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, n("assign"), n("access"), n("hex"),
                        F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def redact(text: str | None, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str | None:
    """``text`` with each (merged) span replaced by ``mark``."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        out += [text[at:a], mark] if a >= at else []
        at = b
    return "".join([*out, text[at:]])


def base_sha256(text: str | None) -> str:
    """Digest of a text's base spans (the plain definition, used in tests)."""
    return hashlib.sha256(render(base_spans(text or "")).encode()).hexdigest()
