"""Toxicity by subword bags: embeddings of character n-grams, averaged over a window of words, into a linear softmax.

Embeddings and softmax are trained together, in numpy, on a bounded sample of labelled rows. A document is
as toxic as its most toxic window, so a few words in a long text count as much as in a short one. Words
have no vector of their own, only their n-grams have, so a misspelling shares most of its vectors with the word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patcheval.llm.common import Recent, each_freed, groups, held_out, logistic, nothing_kept, shared_out, text_of

THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled rows of each class that are fitted on, at most. ``window``: words averaged. Words of over ``word_limit``
    characters are split into parts of ``part`` and what the next one overlaps. ``rows_per_id``: rows of one id fitted on."""

    sample: int = 1500
    buckets: int = 1 << 17
    dim: int = 8
    window: int = 10
    grams: tuple[int, ...] = (3, 5, 7)
    rounds: int = 10
    seed: int = 7
    word_limit: int = 80
    part: int = 8
    rows_per_id: int = 2


@dataclass
class Model:
    embeddings: np.ndarray
    softmax: np.ndarray  # dim x 2
    bias: float
    slope: float
    offset: float
    settings: Settings

    def gram_scores(self) -> np.ndarray:
        """The softmax margin of each bucket's vector: a mean of vectors has the mean of their margins."""
        return (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)


def grams_of(word: str, s: Settings) -> list[int]:
    """Buckets of the n-grams of a word between its bounds."""
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode()) % s.buckets for n in s.grams for i in range(max(1, len(w) - n + 1))]


def words_of(text: str, s: Settings) -> list[str]:
    """Words between white space. One of over ``word_limit`` characters counts as several, of ``part`` new characters each and as
    many of the next as the longest n-gram needs: all its n-grams are in one of them, and windows are as short as elsewhere."""
    words = text.lower().split()
    if not words or max(map(len, words)) <= s.word_limit:
        return words
    step, size = s.part, s.part + max(s.grams) - 1
    cut = lambda w: [w[i : i + size] for i in range(0, len(w) - size + step, step)]
    return [p for w in words for p in (cut(w) if len(w) > s.word_limit else (w,))]


class Scorer:
    def __init__(self, model: Model, entries: int = 100_000):
        self.model = model
        self.scores = model.gram_scores()
        self.recent = Recent(self._learn, entries)

    def _learn(self, new: list[str]) -> list[complex]:
        """The sum of margins of a word's n-grams, and how many there are: as one number, of which many fit into memory."""
        lists = [grams_of(w, self.model.settings) for w in new]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum()))
        sums = np.add.reduceat(self.scores[flat], np.concatenate([[0], np.cumsum(counts)[:-1]])) if new else np.zeros(0)
        return (sums + 1j * counts).tolist()

    def margins(self, texts: list[str]) -> Iterator[float]:
        """The largest mean margin of any window of each text; an empty text has the bias alone."""
        w = self.model.settings.window
        for some in groups(texts):
            lists = [words_of(t, self.model.settings) for t in some]
            values = np.array(self.recent.values(list(chain.from_iterable(lists))), np.complex128).view(np.float64).reshape(-1, 2)
            for a in shared_out(lists, values):
                if not len(a):
                    yield self.model.bias
                    continue
                c = np.concatenate([np.zeros((1, 2)), np.cumsum(a, 0)])
                d = c[w:] - c[:-w] if len(a) > w else c[-1:]
                yield float((d[:, 0] / d[:, 1]).max()) + self.model.bias

    def probability(self, texts: list[str]) -> np.ndarray:
        m = np.fromiter(self.margins(texts), np.float64, len(texts))
        return 1 / (1 + np.exp(-np.clip(self.model.slope * m + self.model.offset, -30, 30)))


# ---- training


def _softmax_step(e, w, b, ids, counts, label, weight, state, rate):
    """One Adagrad step on bags of subwords: ``ids`` of all bags one behind the other, ``counts`` of each."""
    n, starts = len(counts), np.concatenate([[0], np.cumsum(counts)[:-1]])
    mean = np.add.reduceat(e[ids], starts, axis=0) / counts[:, None]
    logits = mean @ w
    logits[:, 1] += b[0]
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    p[np.arange(n), label] -= 1
    p *= (weight / weight.sum())[:, None]
    dw, db, dm = mean.T @ p, p[:, 1].sum(), (p @ w.T) / counts[:, None]
    each = np.repeat(dm, counts, axis=0)
    de = np.stack([np.bincount(ids, weights=each[:, j], minlength=len(e)) for j in range(e.shape[1])], 1)
    for x, d, k in ((e, de, 0), (w, dw, 1)):
        state[k] += d * d
        x -= rate * d / (np.sqrt(state[k]) + 1e-8)
    state[2] += db * db
    b[0] -= rate * db / (np.sqrt(state[2]) + 1e-8)


def fit(texts: list[str], labels: list[int], class_rows: tuple[int, int], s: Settings = Settings()) -> Model:
    """Trains on whole texts. ``class_rows``: labelled rows of each class, for the share of toxic documents.

    Bags are windows. In the first rounds these are random ones of every document, from then on each document's
    highest (what makes it toxic, or looks most like it) and some random ones. Without texts of both classes, or any words, every
    document gets the share of label 1 as its score.
    """
    rng = np.random.default_rng(s.seed)
    e = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float64)
    w = rng.normal(0, 0.1, (s.dim, 2))
    y = np.array(labels, np.int64)
    share = class_rows[1] / max(1, sum(class_rows))
    flat = Model(e, np.zeros_like(w), 0.0, 1.0, float(np.log((share + 1e-4) / (1 - share + 1e-4))), s)
    if not len(y) or y.min() == y.max():
        return flat
    # words are numbered as they come, then in sorted order; only one text's words and some words' n-grams are held as objects
    number: dict[str, int] = {}
    docs = [np.fromiter((number.setdefault(x, len(number)) for x in words_of(t, s)), np.int32) for t in texts]
    names = sorted(number)
    if not names:
        return flat
    rank = np.empty(len(names), np.int32)
    rank[[number[x] for x in names]] = np.arange(len(names))
    docs = [rank[d] for d in docs]
    del number, rank
    counts, found = [], []
    for k in range(0, len(names), 5000):
        grams = [grams_of(x, s) for x in names[k : k + 5000]]
        counts.append(np.fromiter(map(len, grams), np.int64, len(grams)))
        found.append(np.fromiter(chain.from_iterable(grams), np.int32, int(counts[-1].sum())))
    count, buckets = np.concatenate(counts), np.concatenate(found)
    first = np.cumsum(count) - count
    del names, counts, found
    has = np.array([len(d) > 0 for d in docs])
    held = np.arange(len(docs)) % 5 == 4  # not fitted on: calibrates
    use = np.flatnonzero(has & ~held)

    def bags(picked):
        """Buckets of windows (document, first word)."""
        words = [docs[d][i : i + s.window] for d, i in picked]
        sizes = np.array([count[x].sum() for x in words])
        flat = np.concatenate(words)
        n = count[flat]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[flat], n)
        return buckets[at], sizes

    def top(d, score):
        c = np.concatenate([np.zeros((1, 2)), np.cumsum(np.stack([score[docs[d]], count[docs[d]]], 1), 0)])
        m = c[s.window :] - c[: -s.window] if len(docs[d]) > s.window else c[-1:]
        m = m[:, 0] / m[:, 1]
        i = int(m.argmax())
        return i, float(m[i])

    b, state = np.zeros(1), [np.full_like(e, 1e-8), np.full_like(w, 1e-8), 1e-8]
    some = lambda d: (d, int(rng.integers(0, max(1, len(docs[d]) - s.window + 1))))
    word_scores = lambda: np.add.reduceat((e @ (w[:, 1] - w[:, 0]))[buckets], first)
    for r in range(s.rounds):
        if r < 2:
            picked = [some(d) for d in use for _ in range(12)]
        else:
            score = word_scores()
            picked = [(d, top(d, score)[0]) for d in use]
            picked += [some(d) for d in use if y[d] == 0 for _ in range(4)]
        rng.shuffle(picked)
        for k in range(0, len(picked), 1024):
            part = picked[k : k + 1024]
            ids, sizes = bags(part)
            label = y[[d for d, _ in part]]
            _softmax_step(e, w, b, ids, sizes, label, np.ones(len(label)), state, 0.3)
    score = word_scores()
    cal = np.flatnonzero(held & has) if (held & has).sum() >= 20 else np.flatnonzero(has)
    m = np.array([top(d, score)[1] for d in cal]) + b[0]
    t = y[cal]
    scale = np.array([class_rows[0] / max(1, (t == 0).sum()), class_rows[1] / max(1, (t == 1).sum())])[t]
    return Model(e, w, float(b[0]), *logistic(m, t, scale / scale.sum() * len(t)), s)


# ---- Spark jobs


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Fits on at most ``s.sample`` rows of each label, chosen by a hash of the id from all labelled rows that are
    not held out; of rows with the same id the first ``s.rows_per_id`` by text count. Rows without a label of 0 or 1 are
    not learned from."""
    known = labels.select(F.col("doc_id").alias("_l"), F.col("toxic").cast("int").alias("_t")).where("_t in (0, 1)")
    # of repeated labels the higher; chosen by ids first: only the texts of the sample are read out
    ids = docs.select(F.col("doc_id").alias("_d")).where(F.col("_d").isNotNull() & ~held_out(F.col("_d"))).distinct()
    known = known.groupBy("_l").agg(F.max("_t").alias("_t")).join(ids, F.col("_l") == F.col("_d"), "left_semi")
    counts = dict(known.groupBy("_t").count().collect())
    order = F.xxhash64(F.lit(s.seed), "_l")
    chosen = [known.where(F.col("_t") == t).orderBy(order, "_l").limit(s.sample) for t in (0, 1)]
    sample = chosen[0].union(chosen[1])
    rows = (
        docs.select("doc_id", text_of().alias("_x")).join(F.broadcast(sample), F.col("doc_id") == F.col("_l"))  # at most 2 * sample rows
        .select("_t", "_l", "_x", F.row_number().over(Window.partitionBy("_l").orderBy("_x")).alias("_n")).where(F.col("_n") <= s.rows_per_id)
        .orderBy(order, "_x").collect()
    )
    texts, marks = [r["_x"] for r in rows], [r["_t"] for r in rows]
    del rows
    return fit(texts, marks, (counts.get(0, 0), counts.get(1, 0)), s)


def score_column(model: Model, df: DataFrame, text: Column) -> Column:
    """The probability that a text is toxic; a null or empty text has that of no words."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size: buckets x dim

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        nothing_kept()
        scorer = Scorer(shared.value)
        yield from each_freed(batches, lambda batch: pd.Series(scorer.probability(batch.tolist())))
        scorer.recent.forget()  # the worker stays

    return toxicity(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row. Rows repeat as they come; an empty table gives no rows."""
    score = score_column(model, docs, F.col("text"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below ``threshold``, with the columns of ``docs``."""
    return docs.where(score_column(model, docs, F.col("text")) < threshold)
