"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its beginnings. Filters of several widths run
over all words of a text; the largest answer of each filter feeds a logistic output. Thresholds are calibrated for each
language, which is told from the text's own function words, and moved to a score of 0.5.

Fitting takes a bounded sample of labelled rows (MOST_TOXIC, MOST_CLEAN), chosen by a hash of the id, from the learning
fold only; of several texts of one id the one with the least hash. The sample is bounded in words too: texts of more than
MOST_TEXT_WORDS are left out of it, and of the others those that come first by hash until MOST_WORDS are reached, so the
driver never holds more than 6 bytes for each of MOST_WORDS. Every whole text is scored, in blocks of words with bounded memory. Null texts count as empty; texts without
words get the score of no evidence. Labels that are null are not learned from. Extra columns are ignored. Equal texts
have equal scores. An empty label table gives the model without evidence: score below 0.5 for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import groups
from .common import lean, written
from .shingles import words_and_counts

#: Most labelled rows of each kind that the model is fitted on.
MOST_TOXIC, MOST_CLEAN = 4000, 6000
#: Most words of the sample, and of one text in it.
MOST_WORDS, MOST_TEXT_WORDS = 10_000_000, 200_000
BITS, SIZE, FILTERS, WIDTHS, PREFIXES = 16, 12, 8, (1, 2, 3), (5, 7)
EPOCHS, BATCH, RATE, HELD = 8, 32, 0.1, 5
BLOCK_WORDS = 100_000
#: Function words by which a text's language is told (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in a is that for it was with as by on this are be at from",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le la les et des en un une que dans pour qui sur par est au du pas avec ce",
    "es": "el los y en que las un por con una del se para su al no como más es lo",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, SIZE, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    #: By language: logits are held against these; then divided by the scale.
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    scale: float = 1.0


def language_table() -> np.ndarray:
    """The language of each word bucket that holds a function word of one language only; -1 for others."""
    table = np.full(1 << BITS, -1, dtype=np.int8)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        for b in words_and_counts([words], PREFIXES, BITS)[0][:, 0]:
            table[b] = i if table[b] in (-1, i) else -1
    return table


def languages_of(words: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each text the language with most function words, the last if there are none."""
    k = len(FUNCTION_WORDS)
    of = table[words[:, 0]].astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    hit = of >= 0
    by = np.bincount(doc[hit] * k + of[hit], minlength=len(counts) * k).reshape(-1, k)
    return np.where(by.max(axis=1) > 0, by.argmax(axis=1), k)


def answers(model: Model, words: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """For each width the filters' answers at each word; a window ends where its text ends."""
    e = model.embedding[words].sum(axis=1)
    out = []
    for w in model.filters:
        a = e @ w[0]
        for j in range(1, len(w)):
            a[:-j] += (e[j:] @ w[j]) * (doc[j:] == doc[:-j])[:, None]
        out.append(a)
    return out


def pooled(model: Model, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The largest answer of each filter over each whole text; texts without words keep 0."""
    doc = np.repeat(np.arange(len(counts)), counts)
    most = np.full((len(counts), len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
    over = max(WIDTHS) - 1
    for s in range(0, len(words), BLOCK_WORDS):
        e = min(len(words), s + BLOCK_WORDS)
        a = np.concatenate([x[: e - s] for x in answers(model, words[s : e + over], doc[s : e + over])], axis=1)
        d = doc[s:e]
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        most[d[first]] = np.maximum(most[d[first]], np.maximum.reduceat(a, first, axis=0))
    most[counts == 0] = 0
    return most


def logits(model: Model, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.maximum(pooled(model, words, counts) + model.bias, 0) @ model.out + model.out_bias


def fit(texts: list[np.ndarray], y: np.ndarray, clean_weight: float = 1.0, seed: int = 7) -> Model:
    """Trains on word buckets of texts; every HELD-th one is kept for the thresholds."""
    rng = np.random.default_rng(seed)
    n_out = len(WIDTHS) * FILTERS
    m = Model(
        rng.normal(0, 0.15, (1 << BITS, SIZE)).astype(np.float32),
        [rng.normal(0, 0.4, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_out, dtype=np.float32), np.full(n_out, 0.3, dtype=np.float32), -1.0,
    )
    own = np.array([len(t) > 0 for t in texts], dtype=bool)
    learn = np.flatnonzero(own & (np.arange(len(texts)) % HELD != 0))
    if not len(learn) or y[learn].min() == y[learn].max():
        m.out_bias, m.out = -3.0, np.zeros(n_out, dtype=np.float32)
        return m
    past = {k: np.full_like(v, 1e-3) for k, v in {"e": m.embedding, "b": m.bias, "o": m.out, **{f"f{i}": f for i, f in enumerate(m.filters)}}.items()}

    def step(key: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        if rows is None:
            past[key] += grad**2
            value -= RATE * grad / np.sqrt(past[key])
        else:
            past[key][rows] += grad**2
            value[rows] -= RATE * grad / np.sqrt(past[key][rows])

    weight = np.where(y == 1, 0.5 / max(1e-9, (y[learn] == 1).mean()), 0.5 / max(1e-9, (y[learn] == 0).mean())).astype(np.float32)
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for at in range(0, len(learn), BATCH):
            some = learn[at : at + BATCH]
            counts = np.array([len(texts[i]) for i in some])
            words = np.concatenate([texts[i] for i in some])
            doc = np.repeat(np.arange(len(some)), counts)
            first = np.r_[0, np.cumsum(counts)[:-1]]
            every = answers(m, words, doc)
            top = [np.stack([a[x : x + n].argmax(axis=0) + x for x, n in zip(first, counts, strict=True)]) for a in every]
            best = np.concatenate([np.take_along_axis(a, t, axis=0) for a, t in zip(every, top, strict=True)], axis=1)
            h = np.maximum(best + m.bias, 0)
            p = 1 / (1 + np.exp(-(h @ m.out + m.out_bias)))
            g = ((p - y[some]) * weight[some] / len(some)).astype(np.float32)
            gh = g[:, None] * m.out * (h > 0)
            rows, grads = [], []
            for i, w in enumerate(m.filters):
                gi, at_i = gh[:, i * FILTERS : (i + 1) * FILTERS], top[i]
                gw = np.zeros_like(w)
                for j in range(len(w)):
                    here = np.minimum(at_i + j, len(words) - 1)
                    ok = (gi != 0) & (at_i + j < len(words)) & (doc[here] == np.arange(len(some))[:, None])
                    d, f = np.nonzero(ok)
                    if not len(d):
                        continue
                    ww, gg = words[here[d, f]], gi[d, f]
                    np.add.at(gw[j].T, f, gg[:, None] * m.embedding[ww].sum(axis=1))
                    ge = gg[:, None] * w[j][:, f].T
                    rows.append(ww.reshape(-1))
                    grads.append(np.repeat(ge, ww.shape[1], axis=0))
                step(f"f{i}", w, gw)
            if rows:
                r, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(r), SIZE), dtype=np.float32)
                np.add.at(total, inverse, np.concatenate(grads))
                step("e", m.embedding, total, r)
            step("o", m.out, h.T @ g)
            step("b", m.bias, gh.sum(axis=0))
            m.out_bias -= RATE * float(g.sum())
    return calibrated(m, texts, y, clean_weight)


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap at which the weighted errors are least."""
    order = np.argsort(z, kind="stable")
    z, y, weight = z[order], y[order], weight[order]
    wrong = np.r_[0, np.cumsum(np.where(y == 1, weight, 0))] + np.r_[np.cumsum(np.where(y == 0, weight, 0)[::-1])[::-1], 0]
    least = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    edge = np.r_[z[0] - 1, z, z[-1] + 1]
    return float((edge[least[0]] + edge[least[-1] + 1]) / 2)


def calibrated(m: Model, texts: list[np.ndarray], y: np.ndarray, clean_weight: float) -> Model:
    """Thresholds from the texts that were not trained on, pulled to the common one where a language has few."""
    held = np.arange(0, len(texts), HELD)
    counts = np.array([len(texts[i]) for i in held])
    words = np.concatenate([texts[i] for i in held])
    z, lang = logits(m, words, counts), languages_of(words, counts, language_table())
    yh = y[held]
    weight = np.where(yh == 1, 1.0, clean_weight)
    if yh.min() == yh.max():
        return m
    common = best_threshold(z, yh, weight)
    m.thresholds[:] = common
    for i in range(len(LANGUAGES)):
        own = lang == i
        n = min((yh[own] == 1).sum(), (yh[own] == 0).sum())
        if n:
            m.thresholds[i] = (n * best_threshold(z[own], yh[own], weight[own]) + 10 * common) / (n + 10)
    m.scale = max(1e-3, float(np.std(z)))
    return m


def scores(model: Model, texts: list[str], table: np.ndarray) -> np.ndarray:
    words, counts = words_and_counts(texts, PREFIXES, BITS)
    z = logits(model, words, counts) - model.thresholds[languages_of(words, counts, table)]
    return 1 / (1 + np.exp(-np.clip(z * 2 / model.scale, -30, 30).astype(np.float64)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most_true: int, most_false: int, may_learn: Column, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, float]:
    """(t, y) of a bounded sample of labelled rows, and how many rows of label 0 each chosen one stands for, over that of label 1."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & may_learn).groupBy(key).agg(F.max(label).alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = known.filter("y = 1").orderBy(F.xxhash64(key), key).limit(most_true).unionByName(known.filter("y = 0").orderBy(F.xxhash64(key), key).limit(most_false))
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), key)  # at most most_true + most_false ids
    one = rows.groupBy(F.col(key).alias("k")).agg(F.min(F.struct(F.xxhash64("t"), "t", "y")).alias("v"))
    stands = lambda y, most: n.get(y, 0) / max(1, min(n.get(y, 0), most))
    return one.select("k", "v.t", "v.y"), stands(0, most_false) / max(1.0, stands(1, most_true))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    sample, clean_weight = labelled(docs, labels, label, MOST_TOXIC, MOST_CLEAN, may_learn, key, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, counts = words_and_counts(b["t"].tolist(), PREFIXES, BITS)
            cut = np.cumsum(counts)
            yield pd.DataFrame({"k": b["k"].astype(str), "y": b["y"], "w": [words[e - n : e].astype("<u2").tobytes() for e, n in zip(cut, counts, strict=True)]})

    rows, _ = written(sample.mapInPandas(lean(run), "k string, y int, w binary"), "sample")
    size = rows.select("k", (F.length("w") / (2 + 2 * len(PREFIXES))).alias("n")).filter(F.col("n") <= MOST_TEXT_WORDS)
    total = size.withColumn("total", F.sum("n").over(Window.orderBy(F.xxhash64("k", F.lit(5)), "k")))  # a row for each text of the sample
    rows = rows.join(F.broadcast(total.filter(F.col("total") <= MOST_WORDS).select("k")), "k")
    rows = rows.toPandas().sort_values(["k", "y", "w"], kind="stable")
    rows = rows.sample(frac=1, random_state=3)
    texts = [np.frombuffer(w, dtype="<u2").reshape(-1, 1 + len(PREFIXES)) for w in rows["w"]]
    return fit(texts, rows["y"].to_numpy(), clean_weight)


def score(docs: DataFrame, model: Model, columns: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """The named columns of docs and the score of each whole text, as column `out`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    if text not in names:
        names[text] = "t"
    given = names[text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, table = shared.value, language_table()
        for b in batches:
            texts = ["" if t is None else t for t in b[given]]
            found = [scores(m, some, table) for some in groups(texts)]
            yield b[out_names].assign(score=np.concatenate(found) if found else np.zeros(0))

    out_names = [names[c] for c in columns]
    schema = ", ".join(f"{names[c]} {docs.schema[c].dataType.simpleString()}" for c in columns)
    own = docs.select(*(F.col(c).alias(n) for c, n in names.items())).mapInPandas(lean(run), f"{schema}, score double")
    return own.select(*(F.col(names[c]).alias(c) for c in columns), F.col("score").alias(out))


def held_out(key: str, fold: int, folds: int) -> Column:
    """Whether a row is held out by the remainder of crc32 of its id."""
    r = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds
    return r == fold


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of each row of docs, learned from the rows that are not held out."""
    model = train(docs, labels, ~held_out(key, 0, 5), key=key, text=text)
    rows = score(docs, model, [key], text)
    return rows.select(key, held_out(key, 0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
