"""Quality by positive-unlabelled learning: a small network that minimises the non-negative unbiased risk.

Learning takes trusted positives (label 1 of the learning fold), unlabelled web text (all texts, whatever their labels)
and an estimated class prior; labels of 0 are never read. With prior pi, losses l+ and l-, the risk is
pi * E_p[l+] + max(0, E_u[l-] - pi * E_p[l-]), the negative part never below zero. The network's own threshold is the score
of 0.5. The prior comes from scores alone: a network that tells positives from unlabelled text is fitted on one half of both;
on the other half the share of unlabelled texts above a score over that of positives is least, and nearest the prior, where
unlabelled text has least that is no positive; the place is chosen with a bound on its sampling error.

Fitting takes bounded samples (MOST_POSITIVE, MOST_UNLABELLED), chosen by a hash of the id; of several texts of one id the
one with the least features. A text's features are its own characters, words and lines: the shares of characters, of repeated
words and lines, word lengths. Every whole text is scored. Null texts count as empty and get the score of empty features.
Null labels are not learned from; without positives or texts to learn from every score is 0.5. Equal texts have equal scores.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import groups
from .common import lean
from .shingles import FOLD, _counts, word_hashes
from .toxicity import held_out

#: Most rows of each kind that the model is fitted on.
MOST_POSITIVE, MOST_UNLABELLED = 6000, 9000
HIDDEN, EPOCHS, BATCH, RATE = 24, 40, 256, 0.01
#: Least steps of training, for small samples.
LEAST_STEPS = 800
#: Chance that the bound on the prior's sampling error fails, and the weight of that bound.
DELTA, GAMMA = 0.1, 0.01
N_FEATURES = 128 + 14


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    spread: float = 1.0
    prior: float = 0.5


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def features(texts: list[str]) -> np.ndarray:
    """One row of N_FEATURES numbers for each whole text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    fold = [r.translate(FOLD) for r in raw]
    data = b" ".join(fold)
    words = word_hashes(data)
    counts = _counts(fold, data)
    out = np.zeros((len(texts), N_FEATURES), dtype=np.float32)
    at = 0
    for i, (t, r, n) in enumerate(zip(texts, raw, counts, strict=True)):
        h = words[at : at + n]
        at += n
        if not r:
            continue
        byte = np.bincount(np.frombuffer(r, dtype=np.uint8), minlength=256)
        size = len(r)
        out[i, :128] = np.log1p(1000 * byte[:128] / size)
        upper, lower, digit = byte[65:91].sum(), byte[97:123].sum(), byte[48:58].sum()
        high = byte[128:].sum()
        mark = byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()
        lines = t.split("\n")
        top = 0
        distinct = 0
        if n:
            s = np.sort(h)
            edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
            distinct, top = len(edge) - 1, int(np.diff(edge).max())
        out[i, 128:] = (
            _share(upper, upper + lower), _share(digit, size), _share(high, size), _share(mark, size), _share(mark, n) if n else 0,
            _share(size, n) / 10, _share(distinct, n), _share(top, n), _share((h[1:] == h[:-1]).sum(), n), _share(len(set(lines)), len(lines)),
            _share(len(lines), n), np.log1p(n) / 5, np.log1p(size) / 5, np.log1p(_share(size, len(lines))) / 5,
        )
    return out


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled rows, from scores of both (higher: positive likelier), kept off 0 and 1."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    error = np.sqrt(np.log(4 / DELTA) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = np.argmin((above_u + (1 + GAMMA) * error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def risk(params: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float | None) -> tuple[float, list[np.ndarray]]:
    """The risk and the step's gradient. With a prior the non-negative risk: while its negative part is below zero the gradient leads that part
    back up. Without one half the share of wrong positives and half that of wrong unlabelled rows. Loss: s as a negative, 1 - s as a positive."""
    w1, b1, w2, b2 = params
    x = np.concatenate([xp, xu])
    pre = x @ w1 + b1
    h = np.maximum(pre, 0)
    s = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30)))
    p, u = s[: len(xp)], s[len(xp) :]
    is_p = np.arange(len(x)) < len(xp)
    if prior is None:
        value, weight = (1 - p.mean() + u.mean()) / 2, np.where(is_p, -0.5 / len(p), 0.5 / len(u))
    else:
        negative = u.mean() - prior * p.mean()
        value, down = prior * (1 - p.mean()) + max(0.0, negative), np.where(is_p, -prior / len(p), 1 / len(u))
        weight = np.where(is_p, -prior / len(p), 0) + down if negative >= 0 else -down
    g = s * (1 - s) * weight
    gh = np.outer(g, w2) * (pre > 0)
    return float(value), [x.T @ gh, gh.sum(axis=0), h.T @ g, np.array([g.sum()])]


def trained(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int) -> Model:
    """Adam on mini-batches of the risk. Both kinds have rows."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    m = Model(mean.astype(np.float32), scale.astype(np.float32), rng.normal(0, 0.15, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0, prior=0.5 if prior is None else prior)
    xp, xu = scaled(m, positive), scaled(m, unlabelled)
    params = [m.w1, m.b1, m.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    steps = max(1, len(xu) // BATCH)
    for _ in range(max(EPOCHS, LEAST_STEPS // steps)):
        order_p, order_u = rng.permutation(len(xp)), rng.permutation(len(xu))
        for k in range(steps):
            p, u = xp[order_p[k * len(xp) // steps : (k + 1) * len(xp) // steps]], xu[order_u[k * len(xu) // steps : (k + 1) * len(xu) // steps]]
            if not len(p) or not len(u):
                continue
            grads = risk(params, p, u, prior)[1]
            grads[0] += 1e-4 * params[0]
            grads[2] += 1e-4 * params[2]
            t += 1
            for w, a, b, d in zip(params, first, second, grads, strict=True):
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                w -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    m.b2 = float(params[3][0])
    m.spread = max(0.1, float(np.std(logits(m, unlabelled))))
    return m


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, seed: int = 5) -> Model:
    """The network of the non-negative risk; without a prior it is estimated first, each half of the rows being scored by the other's network."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if prior is None:
        apart = [trained(positive[i::2], unlabelled[i::2], None, seed) for i in (0, 1)]
        prior = float(np.mean([estimated_prior(logits(apart[1 - i], positive[i::2]), logits(apart[1 - i], unlabelled[i::2])) for i in (0, 1)]))
    return trained(positive, unlabelled, prior, seed)


def scaled(m: Model, x: np.ndarray) -> np.ndarray:
    return np.clip((x - m.mean) / m.scale, -6, 6)


def logits(m: Model, x: np.ndarray) -> np.ndarray:
    return np.maximum(scaled(m, x) @ m.w1 + m.b1, 0) @ m.w2 + m.b2


def scores(m: Model, texts: list[str]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(m, features(texts)) * 2 / m.spread, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """Learns from rows of label 1 in the learning fold and from texts whose labels are not read."""
    order = (F.xxhash64(key), F.col(key))
    known = labels.filter((F.col(label) == 1) & F.col(key).isNotNull() & may_learn).select(key).distinct()
    own = known.join(docs.select(key), key, "left_semi").orderBy(*order).limit(MOST_POSITIVE).select(key, F.lit(1).alias("role"))
    free = docs.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key, F.lit(1)), key).limit(MOST_UNLABELLED).select(key, F.lit(2).alias("role"))
    chosen = own.unionByName(free).groupBy(key).agg(F.sum("role").alias("role"))  # 1, 2 or both

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for some in groups(b["t"].tolist()):
                x = features(some)
                yield b.iloc[at : at + len(some)][["k", "role"]].assign(x=[v.tobytes() for v in x])
                at += len(some)

    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), key)  # bounded by the two samples
    got = rows.select(F.xxhash64(F.col(key), F.lit(2)).alias("k"), F.col("role").cast("int"), "t").mapInPandas(lean(run), "k bigint, role int, x binary")
    got = got.groupBy("k").agg(F.min(F.struct("x", "role")).alias("v")).select("k", "v.*")  # one text of each id, so as many rows as were chosen
    got = got.toPandas().sort_values(["k", "x"], kind="stable")
    part = lambda r: np.frombuffer(b"".join(got.loc[got["role"].isin([r, 3]), "x"]), dtype=np.float32).reshape(-1, N_FEATURES)
    return fit(part(1), part(2))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of each row of docs, learned from the rows that are not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~held_out(key, 1, 3), key=key, text=text))  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [scores(shared.value, some) for some in groups(["" if t is None else t for t in b["t"]])]
            yield b[["k"]].assign(score=np.concatenate(found) if found else np.zeros(0))

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(lean(run), f"k {kind}, score double").withColumnRenamed("k", key)
    return rows.select(key, held_out(key, 1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
