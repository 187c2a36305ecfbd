"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, all
hashed to buckets; a bag's vector is the mean over its words. Embeddings and softmax are trained
together in numpy. As unseen misspellings share most n-grams with known words, they land near them.

A bag is a window of a few words: a document is as toxic as its most toxic window, so that a few
words in a long text count. Training starts toxic documents with the window of the word whose document
frequencies tell the classes apart best, and later picks each document's strongest window anew in
each epoch. A logistic curve, fitted to the strongest windows of held-back training rows, turns the
window's logit into the score.

The softmax is linear, so for scoring a word comes down to one number, the mean over its buckets.
The model is a vector of ``buckets`` floats; scoring is row-local, without a shuffle.

Training reads at most ``max_train_rows`` labelled rows (a bounded sample by a hash of the id), never
those of the held-out fold; labels, lang, source and doc_id are no inputs.

Defined results: null or empty text scores what the curve gives for no word; without any labelled
row the score is 0; repeated rows score alike, and an id that repeats counts once in training, with its
smallest text; an empty table gives an empty table; other columns
pass through, output columns replace columns of the same name.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import crc_fold
from gneiss.shipping import ship

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityParams:
    max_train_rows: int = 6000
    buckets: int = 1 << 16
    dims: int = 6
    shortest: int = 3
    longest: int = 5
    window: int = 4
    epochs: int = 24
    #: epochs at the end in which positives choose their window by the model
    free_epochs: int = 6
    #: least z of a word that tells toxic documents
    least_z: float = 4.0
    batch: int = 256
    rate: float = 0.3
    decay: float = 1e-4
    seed: int = 7
    threshold: float = 0.7
    cache_words: int = 200_000


def grams(word: str, p: ToxicityParams) -> list[int]:
    """Buckets of a word: itself and its n-grams, with marks at its ends."""
    w = f"<{word}>"
    parts = [w] + [w[i : i + n] for n in range(p.shortest, p.longest + 1) for i in range(len(w) - n + 1)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % p.buckets for x in parts]


class Model:
    """bucket -> its part of the logit; bias; slope and offset of the score's curve."""

    def __init__(self, part: np.ndarray, bias: float, slope: float, offset: float, params: ToxicityParams):
        self.part, self.bias, self.slope, self.offset, self.p = part, bias, slope, offset, params

    def scorer(self):
        p, part, cache = self.p, self.part.astype(np.float64).tolist(), {}

        def of(word: str) -> float:
            g = grams(word, p)
            v = sum([part[x] for x in g]) / len(g)
            if len(cache) >= p.cache_words:
                cache.clear()
            cache[word] = v
            return v

        def score(text: str | None) -> float:
            words = WORD.findall(text.lower()) if text else []
            if not words:
                logit = self.bias
            else:
                get = cache.get
                v = np.array([x if (x := get(w)) is not None else of(w) for w in words])
                total = np.concatenate([[0.0], np.cumsum(v)])
                width = min(len(v), p.window)
                logit = self.bias + (total[width:] - total[:-width]).max() / width
            z = self.slope * logit + self.offset
            return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))

        return score


def curve(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0.05) and offset of a logistic curve, by Newton steps on a lightly penalised likelihood."""
    scale = max(float(np.std(logit)), 1e-6)
    x = np.stack([logit / scale, np.ones_like(logit)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (q - y) + 0.02 * (w - np.array([1.0, 0.0]))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.02 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 0.05) / scale, float(w[1])


def train(texts: list[str | None], toxic: list[int], p: ToxicityParams = ToxicityParams()) -> Model:
    """Fits embeddings and softmax; every fifth row is held back for the score's curve."""
    y = np.array(toxic, np.int64)
    if not len(y):
        return Model(np.zeros(p.buckets, np.float32), 0.0, 1.0, -60.0, p)
    if y.min() == y.max():
        return Model(np.zeros(p.buckets, np.float32), 0.0, 1.0, 60.0 if y[0] else -60.0, p)
    rng = np.random.default_rng(p.seed)
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in WORD.findall((t or "").lower())], np.int32) for t in texts]
    # packed arrays: lists of numbers would take several times the memory
    buckets, sizes = array("i"), array("i")
    for w in ids:
        g = grams(w, p)
        buckets.extend(g)
        sizes.append(len(g))
    lengths, bucket = np.array(sizes, np.int64), np.frombuffer(buckets, np.int32) if len(buckets) else np.empty(0, np.int32)
    first = np.concatenate([[0], np.cumsum(lengths)])
    full = np.nonzero(np.array([len(d) > 0 for d in docs]))[0]
    if not len(full):
        return Model(np.zeros(p.buckets, np.float32), 0.0, 1.0, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), p)
    # the words of all documents, one after the other; a window is known by its first word's place among them
    edges = [0, *np.cumsum([len(docs[i]) for i in full]).tolist()]
    words, spans = np.concatenate([docs[i] for i in full]), list(zip(edges[:-1], edges[1:], strict=True))
    del docs
    widths = np.array([min(b - a, p.window) for a, b in spans], np.int64)
    windows = np.array([b - a for a, b in spans], np.int64) - widths + 1
    label = y[full]
    held = full % 5 == 0
    if len({*label[held]}) < 2 or len({*label[~held]}) < 2:
        held = np.zeros(len(full), bool)
    learn = np.nonzero(~held)[0]

    e = rng.normal(0, 0.1, (p.buckets, p.dims))
    w, c = rng.normal(0, 0.5, (p.dims, 2)), np.log(np.bincount(label, minlength=2) / len(label))
    ge, gw, gc = np.full((p.buckets, p.dims), 1e-6), np.full((p.dims, 2), 1e-6), np.full(2, 1e-6)

    def strongest() -> tuple[np.ndarray, np.ndarray]:
        """Each document's window of the largest logit, and that logit; a document at a time, which needs little memory."""
        part = e @ (w[:, 1] - w[:, 0])
        of_word = np.add.reduceat(part[bucket], first[:-1]) / lengths
        at, logit = np.empty(len(full), np.int64), np.empty(len(full))
        for k, ((a, b), width) in enumerate(zip(spans, widths.tolist(), strict=True)):
            total = np.concatenate([[0.0], np.cumsum(of_word[words[a:b]])])
            sums = total[width:] - total[:-width]
            best = int(np.argmax(sums))
            at[k], logit[k] = a + best, (c[1] - c[0]) + sums[best] / width
        return at, logit

    def telling() -> np.ndarray:
        """Each document's window with the word that tells its class best, by a two-sample test of document frequencies; -1 if no word tells."""
        seen = np.zeros((2, len(ids)))
        for (a, b), one, out in zip(spans, label.tolist(), held.tolist(), strict=True):
            if not out:
                seen[one, np.unique(words[a:b])] += 1
        n1, n0 = max(1, (label[learn] == 1).sum()), max(1, (label[learn] == 0).sum())
        q = (seen.sum(axis=0) + 1) / (n1 + n0 + 2)
        z = (seen[1] / n1 - seen[0] / n0) / np.sqrt(q * (1 - q) * (1 / n1 + 1 / n0))
        best = np.empty(len(full), np.int64)
        for k, ((a, b), width, n) in enumerate(zip(spans, widths.tolist(), windows.tolist(), strict=True)):
            each = z[words[a:b]]
            top = np.max([each[j : j + n] for j in range(width)], axis=0)
            at = int(np.argmax(top))
            best[k] = a + at if top[at] >= p.least_z else -1
        return best

    def step(rows: np.ndarray, starts: np.ndarray) -> None:
        width = widths[rows]
        token = words[np.repeat(starts, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)]
        n = lengths[token]
        at = np.repeat(first[token], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        b, weight = bucket[at], np.repeat(1 / (n * np.repeat(width, width)), n)
        per_bag = np.add.reduceat(n, np.cumsum(width) - width)
        edge = np.cumsum(per_bag) - per_bag
        v = np.add.reduceat(e[b] * weight[:, None], edge, axis=0)
        z = v @ w + c
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(len(rows)), label[rows]] -= 1
        q /= len(rows)
        grad_w, grad_c, grad_v = v.T @ q, q.sum(axis=0), q @ w.T
        per = np.repeat(grad_v, per_bag, axis=0) * weight[:, None]
        grad_e = np.stack([np.bincount(b, per[:, k], p.buckets) for k in range(p.dims)], axis=1) + p.decay * e * (np.bincount(b, minlength=p.buckets) > 0)[:, None] / len(rows)
        ge[:] += grad_e**2
        e[:] -= p.rate * grad_e / np.sqrt(ge)
        gw[:] += grad_w**2
        w[:] -= p.rate * grad_w / np.sqrt(gw)
        gc[:] += grad_c**2
        c[:] -= 0.1 * p.rate * grad_c / np.sqrt(gc)

    signal = telling()
    for epoch in range(p.epochs):
        # negatives: any window at first, then the strongest; positives: the most telling window, at the end the strongest
        any_window = np.array(edges[:-1]) + (rng.random(len(full)) * windows).astype(np.int64)
        chosen = any_window if epoch < 2 else strongest()[0]
        if epoch < p.epochs - p.free_epochs:
            chosen = np.where(label == 1, signal, chosen)
        rows = learn[chosen[learn] >= 0]
        order = rng.permutation(rows)
        for k in range(0, len(order), p.batch):
            step(order[k : k + p.batch], chosen[order[k : k + p.batch]])

    best = strongest()[1]
    fit = held if held.any() else np.ones(len(full), bool)
    slope, offset = curve(best[fit], label[fit].astype(float))
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(c[1] - c[0]), slope, offset, p)


def fit_toxicity(documents: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> Model:
    """Trains on labelled rows outside the held-out fold (crc32 of the id as text, modulo 3, is 1)."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 3) != 1)).select("doc_id", "toxic")
    some = rows.distinct().orderBy(F.xxhash64("doc_id", F.lit(p.seed)), "doc_id", "toxic").limit(p.max_train_rows)
    # the sample is bounded, and so is what is broadcast and collected; of an id that repeats the smallest text counts
    seen = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas()
    seen = seen.sort_values(["doc_id", "toxic"], kind="stable")
    texts, toxic = seen["text"].tolist(), [int(x > 0) for x in seen["toxic"]]
    del seen
    return train(texts, toxic, p)


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on)."""
    ship(docs.sparkSession)
    threshold = model.p.threshold

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for b in batches:
            yield pd.Series([of(t) for t in b], dtype="float64")

    out = docs.withColumn("score", score(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_toxicity(documents, labels)
    out = toxicity(documents.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
