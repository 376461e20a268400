"""Toxicity by class-conditional Kneser-Ney models over bytes.

Two models, one of toxic and one of ordinary labelled texts, predict each byte from
the ``ORDER - 1`` bytes before it. The counts of the longest runs are discounted and
back off to continuation counts (in how many distinct contexts a byte follows) of
ever shorter contexts, and at last to the continuation counts of both classes
together, so that an expression rare in both says little. Letters are lower-case and
punctuation reads as white space.

A text's evidence is the length-normalised difference of its log-likelihoods under
the two models, over the whole text and over its most toxic windows: an insult in a
long text is not averaged away. A logistic curve over these, fitted on one fold under
a model of the other folds, turns it into a score from 0 to 1.

The models learn from at most ``FIT_ROWS`` labelled rows of each class, those with
the smallest hash of their id. Scoring reads every text whole.

Defined cases: null texts count as empty; a text without bytes has no evidence and
gets the curve's value for none; repeated labelled rows count repeatedly; labels with
a null id or label are not used; without a labelled row of either class every score
is 0; only id and text are read; an empty table gives no scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import kernels
from skyledger.llm.store import keep

ORDER = 5
DISCOUNT = 0.75
WINDOWS = (6, 12, 60)
FIT_ROWS = 20_000  # of each class
FOLDS = 4
BARE = kernels.LOWER.copy()  # ASCII punctuation reads as white space
BARE[[*range(9, 14), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def ratios(grams: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, list[tuple]]:
    """Probabilities by class of each run, and for each order from this one down (runs, log ratio, contexts, log ratio of their backoff).

    ``n`` has one row of counts for each class, ordinary first.
    """
    if order == 1:
        shared = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * 256)
        return np.stack([shared, shared]), []
    context, of = np.unique(grams >> np.uint64(8), return_inverse=True)
    lower, to = np.unique(grams & np.uint64((1 << 8 * (order - 1)) - 1), return_inverse=True)
    below, tables = ratios(lower, np.stack([np.bincount(to, n[c] > 0, len(lower)) for c in (0, 1)]), order - 1)
    p, rests = [], []
    for c in (0, 1):
        total, kinds = np.bincount(of, n[c], len(context)), np.bincount(of, n[c] > 0, len(context))
        rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        p.append(np.maximum(n[c] - DISCOUNT, 0) / np.maximum(total, 1)[of] + rest[of] * below[c][to])
        rests.append(rest)
    return np.stack(p), [(grams, np.log(p[1] / p[0]), context, np.log(rests[1] / rests[0])), *tables]


class Model:
    """Log-likelihood ratios by order, and the curve."""

    def __init__(self, tables: list[tuple], curve: np.ndarray):
        self.curve = curve
        self.tables = [(kernels.Lookup(g, r, np.nan), kernels.Lookup(c, b, 0.0)) for g, r, c, b in tables]

    def difference(self, grams: np.ndarray) -> np.ndarray:
        """Log-likelihood of the last byte of each run in toxic texts less that in ordinary ones."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for k, (seen, backoff) in enumerate(self.tables):
            g = grams[left] & np.uint64((1 << 8 * (ORDER - k)) - 1)
            value = seen.get(g)
            found = ~np.isnan(value)
            out[left[found]] += value[found]
            left, g = left[~found], g[~found]
            if not len(left):
                break
            out[left] += backoff.get(g >> np.uint64(8))
        return out

    def evidence(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean over the text and largest mean of a window of each length, for each text."""
        grams, first = kernels.byte_grams(BARE[data], off, ORDER)
        n = np.diff(first)
        total = np.concatenate([[0.0], np.cumsum(self.difference(grams))])
        out = np.empty((len(n), 1 + len(WINDOWS)))
        out[:, 0] = (total[first[1:]] - total[first[:-1]]) / n
        at, begin = np.arange(len(grams)), np.repeat(first[:-1], n)
        for k, size in enumerate(WINDOWS):
            mean = (total[at + 1] - total[np.maximum(at + 1 - size, begin)]) / size
            out[:, k + 1] = np.maximum.reduceat(mean, first[:-1])
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve[1:] + self.curve[0], -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton steps with a small ridge; intercept first."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-3] * (x.shape[1] - 1)) * len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[tuple], np.ndarray]:
    """The tables and the curve, from labelled rows that ``train`` (a condition over the id column) picks."""
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).where(train).select(F.col(key).cast("long").alias("l"), (F.col(label) == 1).cast("int").alias("y"))
    picked = [marks.where(F.col("y") == c).orderBy(F.xxhash64("l"), "l").limit(FIT_ROWS) for c in (0, 1)]
    marks = keep(picked[0].unionAll(picked[1]), "marks")
    rows = docs.where(train).select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(marks), F.col("k") == F.col("l"))
    fold = F.pmod(F.xxhash64("k"), F.lit(FOLDS)) == 0

    def count(batches):
        for batch in batches:
            y = batch.column(0).to_numpy()
            for start, data, off in kernels.slices(batch.column(1)):
                grams, first = kernels.byte_grams(BARE[data], off, ORDER)
                packed, n = np.unique((grams << np.uint64(2)) | np.repeat(y[start:start + len(off) - 1], np.diff(first)).astype(np.uint64), return_counts=True)
                yield pa.record_batch([pa.array((packed & np.uint64(3)).astype(np.int32)), pa.array((packed >> np.uint64(2)).astype(np.int64)), pa.array(n)], names=["c", "g", "n"])

    found = rows.select((2 * fold.cast("int") + F.col("y")).alias("y"), "t").mapInArrow(count, "c int, g long, n long")
    table = found.groupBy("g").agg(*[F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(4)]).orderBy("g").toArrow()
    grams = table.column("g").to_numpy().astype(np.uint64)
    n = np.stack([table.column(f"n{c}").to_numpy() for c in range(4)]).astype(float)
    part, all_ = n[:2], n[:2] + n[2:]
    none = np.zeros(1 + 1 + len(WINDOWS))
    if not (len(grams) and (all_.sum(axis=1) > 0).all()):
        none[0] = -np.inf
        return [], none
    tables = ratios(grams, all_, ORDER)[1]
    none[:2] = -1.0, 1.0
    if not (part.sum(axis=1) > 0).all():
        return tables, none
    used = part.sum(axis=0) > 0
    got = evidence(rows.where(fold).select("y", "t"), ratios(grams[used], part[:, used], ORDER)[1])
    return tables, logistic(got[:, 1:], got[:, 0]) if len(got) and 0 < got[:, 0].sum() < len(got) else none


def evidence(sample: DataFrame, tables: list[tuple]) -> np.ndarray:
    """(label, evidence) of the rows of a bounded sample."""
    shared = sample.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        model = Model(shared.value, np.zeros(1))
        for batch in batches:
            y = batch.column(0).to_numpy()
            for start, data, off in kernels.slices(batch.column(1)):
                e = model.evidence(data, off)
                yield pa.record_batch([pa.array(x) for x in (y[start:start + len(e)].astype(float), *np.ascontiguousarray(e.T))], names=[f"c{k}" for k in range(2 + len(WINDOWS))])

    table = sample.mapInArrow(run, ", ".join(f"c{k} double" for k in range(2 + len(WINDOWS)))).toArrow()
    return np.stack([c.to_numpy() for c in table.columns], axis=1) if len(table) else np.zeros((0, 2 + len(WINDOWS)))


def score(docs: DataFrame, fitted: tuple[list[tuple], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        model = Model(*shared.value)
        for batch in batches:
            for start, data, off in kernels.slices(batch.column(1)):
                s = model.score(model.evidence(data, off)) if model.tables else np.zeros(len(off) - 1)
                yield pa.record_batch([batch.column(0).slice(start, len(off) - 1), pa.array(s)], names=[key, "score"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"`{key}` long, score double")
