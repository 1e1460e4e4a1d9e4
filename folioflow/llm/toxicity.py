"""Toxicity: a linear-chain conditional random field tags toxic spans; marginals give document scores and offsets.

Learning takes a bounded sample of labelled documents: at most `max_toxic` and `max_clean` rows of at most `max_chars`
characters, the first by a hash of their ids among those that have a document, and of each class no more of them than
fit in half of `max_tokens` tokens. One task fits the model, wherever Spark puts it, and only weights come back. A
token is labelled toxic when its document is and the token's form is found in toxic documents far more often than in
clean ones: log odds of at least `LEAST_ODDS`, and that at least `LEAST_Z` standard errors from none, so the rule
scales with the sample; document labels become token labels. The field has a weight for each form of a bounded list,
one for all other forms, and four transition weights, fitted by gradient ascent of the penalised conditional
likelihood; expectations come from forward and backward passes over segments of `SEGMENT` tokens. A document's score
is a logistic function, fitted on the same sample, of its expected number of toxic tokens and its highest marginal.

Scoring maps over whole texts where they lie: the model is a few thousand weights, and nothing is shuffled. A form is
a lower-cased token without the non-letters at its ends.

Defined cases: null and empty texts get the score of a text without toxic tokens; null ids are never learnt from;
repeated rows count once in the sample and are each scored; where the sample lacks a class the score is the share of
toxic rows in it (0 without rows), and where no form is toxic, nothing speaks against a document and the score is 0;
extra columns are ignored or, in the filter, kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

FORMS = 4096
LEAST_ODDS, LEAST_Z = 4.0, 2.75
SEGMENT = 256
BATCH_TOKENS = 250_000
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
TOKEN = re.compile(r"[^ \t-\r]+")


def form(token: str) -> str:
    return EDGES.sub("", token).lower()


class Weights(dict):
    """token -> weight of its form; remembers tokens up to a bound."""

    def __init__(self, forms: dict[str, float], other: float) -> None:
        self.forms, self.other = forms, other

    def __missing__(self, token: str) -> float:
        if len(self) > 100_000:
            self.clear()
        self[token] = w = self.forms.get(form(token), self.other)
        return w


def marginals(emits: list[np.ndarray], trans: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """P(toxic) of every token, the expected transition counts, and the summed log partition functions.

    Two states, so a forward message is one ratio r = a(1)/a(0) and a backward message one ratio. Documents are laid
    out step by step, longest first, and each step is one vector operation over the documents that still run.
    """
    lengths = np.array([len(e) for e in emits], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    n = lengths[order]
    out = [np.zeros(0)] * len(emits)
    counts = np.zeros((2, 2))
    if not len(order):
        return out, counts, 0.0
    steps = int(n[0])
    active = np.searchsorted(-n, -np.arange(steps), side="left")  # documents longer than t
    offs = np.concatenate(([0], np.cumsum(active)))
    e = np.empty(offs[-1])
    for k, d in enumerate(order):
        e[offs[: n[k]] + k] = emits[d]
    x = np.exp(e)
    a = np.exp(trans)
    r = np.empty_like(x)
    scale = np.zeros(len(order))  # log a(0)
    r[: active[0]] = x[: active[0]]
    for t in range(1, steps):
        m, p = active[t], offs[t]
        before = r[offs[t - 1] : offs[t - 1] + m]
        zero = a[0, 0] + a[1, 0] * before
        scale[:m] += np.log(zero)
        r[p : p + m] = x[p : p + m] * (a[0, 1] + a[1, 1] * before) / zero
    b = np.ones_like(x)
    for t in range(steps - 2, -1, -1):
        m, p = active[t + 1], offs[t + 1]
        y = x[p : p + m] * b[p : p + m]
        b[offs[t] : offs[t] + m] = (a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y)
        before = r[offs[t] : offs[t] + m]
        joint = np.array([[np.broadcast_to(a[0, 0], y.shape), a[0, 1] * y], [a[1, 0] * before, a[1, 1] * before * y]])
        counts += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
    rb = r * b
    prob = rb / (1 + rb)
    last = np.array([r[offs[n[k] - 1] + k] for k in range(len(order))])
    for k, d in enumerate(order):
        out[d] = prob[offs[: n[k]] + k]
    return out, counts, float((scale + np.log1p(last)).sum())


def in_slices(ids: list[np.ndarray], w: np.ndarray, trans: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """marginals of texts given as numbers of forms, at most BATCH_TOKENS tokens (or one text) at a time: the working arrays stay small whatever the sample."""
    ends = np.cumsum([len(i) for i in ids]) // BATCH_TOKENS
    probs: list[np.ndarray] = []
    counts = np.zeros((2, 2))
    for at in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ends)) + 1):
        p, c, _ = marginals([w[ids[k]] for k in at], trans)
        probs += p
        counts += c
    return probs, counts


@dataclass
class Model:
    forms: dict[str, float] = field(default_factory=dict)
    other: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logistic: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float | None = None

    def score(self, probs: list[np.ndarray]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(probs), self.prior)
        return 1 / (1 + np.exp(-(features(probs) @ np.array(self.logistic))))


def features(probs: list[np.ndarray]) -> np.ndarray:
    return np.array([[1.0, np.log1p(p.sum()), p.max(initial=0.0)] for p in probs]).reshape(-1, 3)


def toxic_forms(hit: Counter, miss: Counter, n_toxic: int, n_clean: int) -> dict[str, float]:
    """form -> log odds of the forms that toxic documents have far more often; hit and miss: documents of each class that have a form."""
    out = {}
    for w, h in hit.items():
        a, b, c, d = h + 0.5, n_toxic - h + 0.5, miss[w] + 0.5, n_clean - miss[w] + 0.5
        odds = float(np.log(a * d / (b * c)))
        if odds >= LEAST_ODDS and odds >= LEAST_Z * (1 / a + 1 / b + 1 / c + 1 / d) ** 0.5:
            out[w] = odds
    return out


def fit(rows: list[tuple[str, int]], rounds: int = 40, penalty: float = 0.05) -> Model:
    """The field and the logistic function from (text, label) rows."""
    rows = sorted(set(rows))
    y = np.array([label for _, label in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(prior=float(y.mean()) if len(y) else 0.0)
    forms_of: dict[str, str] = {}  # equal tokens share one string: the sample has millions
    tokens = [[forms_of.setdefault(t, form(t)) for t in TOKEN.findall(text)] for text, _ in rows]
    del rows, forms_of
    # near copies would make their own words look toxic: of texts that share their least hash of 5 words, one is learnt from
    least = [min(zlib.crc32(" ".join(ts[i : i + 5]).encode()) for i in range(max(1, len(ts) - 4))) for ts in tokens]
    once = list({(k, label): i for i, (k, label) in reversed(list(enumerate(zip(least, y, strict=True))))}.values())[::-1]
    tokens, y = [tokens[i] for i in once], y[once]
    hit, miss = Counter(), Counter()
    for ts, label in zip(tokens, y, strict=True):
        (hit if label else miss).update(set(ts) - {""})
    toxic = toxic_forms(hit, miss, int(y.sum()), int(len(y) - y.sum()))
    if not toxic:
        return Model(prior=0.0)
    often = hit + miss
    forms = sorted(toxic, key=lambda w: (-toxic[w], w))[:FORMS]
    forms += [w for w in sorted(often, key=lambda w: (-often[w], w)) if w not in toxic][: FORMS - len(forms)]
    at = {w: i for i, w in enumerate(forms)}
    other = len(forms)
    ids = [np.array([at.get(w, other) for w in ts], dtype=np.int32) for ts in tokens]
    tags = [np.array([label and w in toxic for w in ts], dtype=float) for ts, label in zip(tokens, y, strict=True)]
    del tokens
    short = [x[i : i + SEGMENT] for x in ids for i in range(0, len(x), SEGMENT)]
    flat, flags = np.concatenate([np.zeros(0, np.int32), *short]), np.concatenate([np.zeros(0), *tags])
    seen = np.bincount(flat, flags, other + 1)
    moves = np.zeros((2, 2))
    for t in (x[i : i + SEGMENT].astype(int) for x in tags for i in range(0, len(x), SEGMENT)):
        np.add.at(moves, (t[:-1], t[1:]), 1)
    w, trans = np.zeros(other + 1), np.zeros((2, 2))
    w[:] = np.log((flags.sum() + 1) / (len(flags) - flags.sum() + 1))
    gw, gt = np.full(other + 1, 1e-3), np.full((2, 2), 1e-3)
    for _ in range(rounds):  # AdaGrad
        probs, counts = in_slices(short, w, trans)
        dw = seen - np.bincount(flat, np.concatenate([np.zeros(0), *probs]), other + 1) - penalty * w
        dt = moves - counts - penalty * trans
        gw, gt = gw + dw * dw, gt + dt * dt
        w, trans = w + 1.0 * dw / np.sqrt(gw), trans + 0.5 * dt / np.sqrt(gt)
    model = Model({f: float(w[i]) for f, i in at.items()}, float(w[other]), trans)
    x = features(in_slices(ids, w, trans)[0])
    beta = np.zeros(3)
    for _ in range(25):  # Newton's steps, with a small ridge
        p = 1 / (1 + np.exp(-(x @ beta)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - 0.1 * beta)
    model.logistic = tuple(float(b) for b in beta)
    return model


def sample(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str, text: str, max_toxic: int, max_clean: int, max_chars: int, max_tokens: int) -> DataFrame:
    """text, toxic of the labelled documents that are learnt from (see above); `learn` speaks of the column doc_id."""
    of = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learn & F.col("toxic").isin(0, 1))
    of = of.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    t = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).where(F.char_length("text") <= max_chars)
    found = of.join(t.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = found.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(found.where("toxic = 0").orderBy(*order).limit(max_clean))
    # at most max_toxic + max_clean ids
    met = t.join(F.broadcast(staged(ids, "sample-ids")), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    tokens = F.sum(F.regexp_count("text", F.lit("[^ \\t-\\r]+"))).over(Window.partitionBy("toxic").orderBy(*order))
    return met.withColumn("__n", tokens).where(F.col("__n") <= max_tokens // 2).select("text", "toxic")


MODEL = "forms array<string>, weights array<double>, other double, trans array<double>, logistic array<double>, prior double"


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", max_toxic: int = 1500, max_clean: int = 2500, max_chars: int = 20_000, max_tokens: int = 3_000_000) -> Model:
    """The model, fitted in one task on the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fit([(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
        row = {"forms": list(m.forms), "weights": list(m.forms.values()), "other": m.other, "trans": m.trans.reshape(-1).tolist(), "logistic": list(m.logistic), "prior": m.prior}
        d = pa.float64()
        kinds = {"forms": pa.list_(pa.string()), "weights": pa.list_(d), "other": d, "trans": pa.list_(d), "logistic": pa.list_(d), "prior": d}
        yield pa.RecordBatch.from_arrays([pa.array([row[k]], v) for k, v in kinds.items()], names=list(kinds))

    some = sample(docs, labels, F.lit(True) if learn is None else learn, doc_id, text, max_toxic, max_clean, max_chars, max_tokens)
    r = staged(some.repartition(1).mapInArrow(run, MODEL), "toxicity-model").first()  # one row of at most FORMS weights
    if r is None:  # Spark may find out beforehand that there is no row
        return Model(prior=0.0)
    return Model(dict(zip(r.forms, r.weights, strict=True)), r.other, np.array(r.trans).reshape(2, 2), tuple(r.logistic), r.prior)


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Character offsets of runs of tokens that are likelier toxic than not."""
    if not len(p) or p.max() < least:
        return []
    out: list[dict] = []
    for i, m in enumerate(TOKEN.finditer(text)):
        if p[i] >= least:
            if i and p[i - 1] >= least:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
    return out


def _scored(model: Model, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
    weights = Weights(model.forms, model.other)
    scores: list[np.ndarray] = []
    found: list[list[dict]] = []
    some: list[str] = []
    size = 0

    def flush() -> None:
        emits = []
        for t in some:
            ts = TOKEN.findall(t)
            emits.append(np.fromiter(map(weights.__getitem__, ts), float, len(ts)))
        probs = marginals(emits, model.trans)[0]
        scores.append(model.score(probs))
        found.extend(spans(t, p) for t, p in zip(some, probs, strict=True))
        some.clear()

    for t in texts:
        some.append(t or "")
        size += len(some[-1]) // 6
        if size >= BATCH_TOKENS:
            flush()
            size = 0
    flush()
    return np.concatenate(scores), found


def toxicity_scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, spans array<struct<start, end>> (character offsets) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FORMS weights
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score, found = _scored(sent.value, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "score", "spans"])

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:int,end:int>>")


def toxicity_filter(docs: DataFrame, model: Model, most: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that score below `most`, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score, _ = _scored(sent.value, b.column(at).to_pylist())
                yield b.filter(pa.array(score < most))

    return docs.mapInArrow(run, docs.schema)
