"""Quality classifier learned from trusted positives and unlabelled web text.

With ``g`` the score, ``p`` the positives, ``u`` the unlabelled and ``prior`` the share of good
texts among the unlabelled, the risk is ``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior *
E_p[l(-g)])``: what the unlabelled say about bad texts, less the good ones among them, never below
zero. The loss is the sigmoid's. Features are shares of characters and words of the whole text.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from spreadlake.llm.common import WordHasher, mix, slices, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that fitting collects at most, about: trusted positives and unlabelled texts.
POSITIVES, UNLABELLED = 20_000, 40_000

#: Steps of gradient descent, and the weight of the squared coefficients.
STEPS, RIDGE = 500, 1e-4

#: Score from which a text is taken for good.
THRESHOLD = 0.3

_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".,;:?'\"()-", "!", "|", "#$%&*+=<>@^_~/\\[]{}`")
N_FEATURES = len(_GROUPS) + 2 + 6


def features(column: pa.Array, hasher: WordHasher) -> np.ndarray:
    """texts x ``N_FEATURES``; all zero for null and empty texts."""
    kind = np.full(256, len(_GROUPS), np.int64)
    kind[128:] = len(_GROUPS) + 1
    for k, letters in enumerate(_GROUPS):
        kind[list(letters.encode())] = k
    data, off = utf8(column)
    n, kinds = len(off) - 1, len(_GROUPS) + 2
    size = np.diff(off)
    of = np.repeat(np.arange(n), size)
    chars = np.bincount(of * kinds + kind[data[off[0] : off[-1]]], minlength=n * kinds).reshape(n, kinds)
    shares = chars / np.maximum(size, 1)[:, None]

    words, counts = hasher.batch(column)
    doc = np.repeat(np.arange(n), counts)
    many = np.maximum(counts, 1)
    again = np.concatenate(([False], (words[1:] == words[:-1]) & (doc[1:] == doc[:-1]))) if len(words) else np.zeros(0, bool)
    repeated = np.bincount(doc, again, minlength=n) / many
    _, first, times = np.unique(mix(words + mix(doc.astype(np.uint64))), return_index=True, return_counts=True)
    distinct = np.bincount(doc[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, doc[first], times)
    # a lone character that stands where a word would
    per_word = np.minimum(size / many, 40) / 40
    extra = [repeated, distinct / many, top / many, per_word, np.log1p(counts) / 12, np.minimum(counts / np.maximum(chars[:, 7], 1), 50) / 50 * (chars[:, 7] > 0)]
    return np.column_stack([np.sqrt(shares), *extra]) * (size > 0)[:, None]


def spread(x: np.ndarray) -> np.ndarray:
    """Features, their squares and a constant."""
    return np.column_stack([x, x * x, np.ones(len(x))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of the two upper tails of any feature's cell.

    Where positives are common and unlabelled texts rare in comparison, the unlabelled ones are all
    positive, so no share can be above that ratio.
    """
    best = 1.0
    for k in range(positive.shape[1]):
        cuts = np.unique(np.quantile(positive[:, k], np.linspace(0, 1, 21)))
        p = np.histogram(positive[:, k], np.concatenate(([-np.inf], cuts, [np.inf])))[0] / len(positive)
        u = np.histogram(unlabelled[:, k], np.concatenate(([-np.inf], cuts, [np.inf])))[0] / len(unlabelled)
        enough = p >= 0.04
        if enough.any():
            best = min(best, float((u[enough] / p[enough]).min()))
    return best


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Coefficients over ``spread`` that minimise the non-negative risk; features are scaled inside."""
    both = spread(np.vstack([positive, unlabelled]))
    mean, sd = both.mean(axis=0), both.std(axis=0)
    mean[-1], sd[-1] = 0, 1
    sd[sd < 1e-9] = 1
    p, u = (spread(positive) - mean) / sd, (spread(unlabelled) - mean) / sd
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        dp, du = sp * (1 - sp), su * (1 - su)
        bad = su.mean() - prior * sp.mean()
        up = p.T @ dp / len(p)
        negative = u.T @ du / len(u) - prior * up
        # below zero the risk of bad texts is overfitted: step back from it
        grad = -prior * up + negative if bad >= 0 else -negative
        grad = grad + RIDGE * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w = w / sd
    w[-1] -= (w * mean)[:-1].sum()
    return w


def _feature_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def work(batches):
        hasher = WordHasher()
        for part in slices(batches, 1, 1 << 20):
            x = features(part.column(1), hasher)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(work, "doc_id bigint, x array<double>")


def _some(doc_id: Column, bound: int, total: int) -> Column:
    """About ``bound`` of ``total`` rows, the same ones at every run."""
    return F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < F.lit(int(1e6 * min(1.0, bound / max(total, 1))))


def learn(
    docs: DataFrame, labels: DataFrame, taught: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> np.ndarray | None:
    """Coefficients, or None where there is no positive or no text to learn from.

    ``taught`` says which rows may be learned from. Fitting collects about ``positives`` and
    ``unlabelled`` rows of features, chosen by a hash of the id; the share of label 1 among the
    labels is the class prior, and where no label is 0 it is estimated from the texts.
    """
    known = labels.filter(taught & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).alias(label))
    share = known.agg(F.count("*"), F.sum((F.col(label) == 1).cast("long"))).first()
    total, good = int(share[0]), int(share[1] or 0)
    n_docs = docs.filter(taught).count()
    if not good or not n_docs:
        return None
    web = _feature_rows(docs.filter(taught & _some(F.col(doc_id), unlabelled, n_docs)), doc_id, text)
    trusted = known.filter((F.col(label) == 1) & _some(F.col(doc_id), positives, good)).select(F.col(doc_id).alias("_id"))
    # texts first meet their label, so that only those sampled are read into features
    sample = docs.filter(taught & _some(F.col(doc_id), positives, good)).join(trusted, F.col(doc_id) == F.col("_id"), "left_semi")
    p = np.array([r[0] for r in _feature_rows(sample, doc_id, text).select("x").orderBy("x").collect()])
    u = np.array([r[0] for r in web.select("x").orderBy("x").collect()])
    if not len(p) or not len(u):
        return None
    prior = good / total if good < total else estimated_prior(p, u)
    return fit(p, u, min(prior, 0.99))


def score(docs: DataFrame, weights: np.ndarray | None, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted, ``keep``) of every row, from its text alone.

    Null and empty texts have features of zero and a score like any other. Without coefficients
    every score is 0.5. Repeated rows are scored each.
    """
    others = [c for c in keep if c != text]
    # the text travels once, also where it is kept
    place = {c: 2 + i for i, c in enumerate(others)} | {text: 1}

    def work(batches):
        hasher = WordHasher()
        for part in slices(batches, 1, 1 << 20):
            s = np.full(part.num_rows, 0.5) if weights is None else sigmoid(spread(features(part.column(1), hasher)) @ weights)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), *(part.column(place[c]) for c in keep)],
                ["doc_id", "score", "predicted", *keep],
            )

    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text), *others).mapInArrow(
        work, "doc_id bigint, score double, predicted int" + kept
    )
