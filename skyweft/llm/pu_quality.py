"""Quality classifier by positive-unlabelled learning.

The risk of a logistic score is written without negatives: pi * R+(P) + max(0, R-(U) - pi * R-(P)),
with P the trusted positives, U all texts and pi the class prior. With the logistic loss the gradient
is E_U[s(z) x] - pi E_P[x] and the curvature E_U[s(1 - s) x x'], which one pass over a narrow feature
table yields, so each Newton step is one Spark job over the whole corpus that returns sums of a fixed
number of features. Where R-(U) - pi R-(P) falls below zero, the step follows its gradient upwards
instead (non-negative correction).

The prior is estimated from P and U alone: labelled negatives serve for nothing. For any score and
threshold the share of U above it is at least pi times the share of P above it, so their quotient
bounds pi from above, and where the score parts the classes well, closely. First fits with a
small pi, which order texts by their ratio of densities in P and U whatever the true one is, give the
score, each fold's rows by the fit that left the fold out; the least quotient over thresholds
that keep LEAST_KEPT of P or more is taken.

The ridge penalty is chosen among RIDGES by the risk on FOLDS folds of the training positives and of
the texts, dealt by a hash of the features. All penalties and folds are fitted in the same passes.

No row is sampled: U is every document and P every trusted positive of the training part.

Defined cases: a null text counts as empty, and both have a score; a null doc_id is never labelled
and is not held out; a doc_id labelled twice counts once, with its largest label; repeated rows each
get a row; without positives every score is 0.5. An empty table gives no rows. Further columns,
whatever their names, are never read.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweft.llm.batches import sliced
from skyweft.session import discard, materialize

STEPS = 14
#: Ridge penalties on standardised weights that are tried, and the folds they are tried on.
RIDGES, FOLDS = (1e-3, 1e-2, 1e-1), 2
#: Steps of the score in the search for the prior, the share of positives that a threshold has to keep, and the prior of the first fits.
LEVELS, LEAST_KEPT, SMALL_PRIOR = 1000, 0.8, 0.05
#: Size of the upward steps of the non-negative correction.
BACK = 0.2
N = 26
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@[]^_`{|}~\\"]] = True


def features(text: str | None) -> list[float]:
    """Shape of a text: shares of byte kinds, word lengths, repetition; all bounded."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(data, minlength=256)
    n = max(1, len(data))
    words = text.split()
    m = max(1, len(words))
    kinds = len(set(words))
    again = sum(map(eq, words, words[1:]))
    skip = sum(map(eq, words, words[2:]))
    lines = text.split("\n")
    letters = int(count[65:91].sum() + count[97:123].sum() + count[128:].sum())
    share = [
        count[_UPPER].sum() / n,
        count[_SYMBOL].sum() / n,
        count[124] / n,
        count[33] / n,
        count[48:58].sum() / n,
        (count[44] + count[46]) / n,
        count[10] / n,
        letters / n,
        count[128:].sum() / n,
        again / m,
        skip / m,
        1 - kinds / m,
        1 - len(set(lines)) / max(1, len(lines)),
    ]
    mean = len(text) / m
    return [
        1.0,
        *(float(x) for x in share),
        *(math.sqrt(x) for x in share[:5]),
        math.sqrt(share[9]),
        math.sqrt(share[10]),
        min(mean, 30.0) / 10,
        math.log1p(len(words)) / 5,
        math.log1p(kinds) / 5,
        kinds / math.sqrt(m) / 10,
        float(not words),
    ]


def _feature_rows(batches):
    for batch in sliced(batches):
        x = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "x"])


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, N)


def _sums(fn, width: int):
    """Sums over all rows of what ``fn(x, positive, fold)`` returns for a batch, as ``width`` numbers."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += fn(_matrix(batch.column(0)), np.asarray(batch.column(1), bool), np.asarray(batch.column(2)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], names=["i", "v"])

    return run


def _total(table: DataFrame, fn, width: int) -> np.ndarray:
    rows = table.select("x", "positive", "fold").mapInArrow(_sums(fn, width), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in rows:  # one row per sum
        out[r["i"]] = r["v"]
    return out


def _moments(x, positive, fold):
    """Numbers of texts and of positives by fold, then sums of features, of squares, and of positives' features by fold."""
    p, pf = x[positive], fold[positive]
    return np.concatenate([np.bincount(fold, minlength=FOLDS), np.bincount(pf, minlength=FOLDS), x.sum(0), (x * x).sum(0), *(p[pf == k].sum(0) for k in range(FOLDS))])


def _curves(models, mean, scale):
    """Losses, gradients and curvature of several models (weights, fold left out)."""

    def fn(x, positive, fold):
        x = (x - mean) / scale
        out = []
        for w, left_out in models:
            v, p = (x, positive) if left_out < 0 else (x[fold != left_out], positive[fold != left_out])
            z = v @ w
            s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            loss = np.logaddexp(0, z)
            out += [[loss.sum(), loss[p].sum()], s @ v, s[p] @ v[p], ((v * (s * (1 - s))[:, None]).T @ v).ravel()]
        return np.concatenate(out)

    return fn


def _losses(models, mean, scale):
    """Each model's sums of losses on the fold it did not see: of U as negatives, of P as negatives and as positives."""

    def fn(x, positive, fold):
        x = (x - mean) / scale
        out = []
        for w, left_out in models:
            seen = fold == left_out
            z = x[seen] @ w
            p = positive[seen]
            out += [np.logaddexp(0, z).sum(), np.logaddexp(0, z[p]).sum(), np.logaddexp(0, -z[p]).sum()]
        return np.array(out)

    return fn


def _levels(models, mean, scale):
    """How many texts, and how many positives, have a score in each of LEVELS steps, by the model that did not see them."""

    def fn(x, positive, fold):
        x = (x - mean) / scale
        out = np.zeros(2 * LEVELS)
        for w, left_out in models:
            mine = (fold == left_out) | (left_out < 0)
            at = ((np.clip(x[mine] @ w, -20, 19.99) + 20) * LEVELS / 40).astype(int)
            out += np.concatenate([np.bincount(at, minlength=LEVELS), np.bincount(at[positive[mine]], minlength=LEVELS)])
        return out

    return fn


class _Scale:
    """Standardised features and counts by fold."""

    def __init__(self, table: DataFrame):
        m = _total(table, _moments, 2 * FOLDS + (2 + FOLDS) * N)
        self.n, self.n_pos = m[:FOLDS], m[FOLDS : 2 * FOLDS]
        sums = m[2 * FOLDS :].reshape(-1, N)
        n = max(1.0, self.n.sum())
        self.mean = sums[0] / n
        self.scale = np.sqrt(np.maximum(sums[1] / n - self.mean**2, 0))
        self.mean[0], self.scale[0] = 0.0, 1.0
        self.scale[self.scale < 1e-6] = 1.0
        self.positives = sums[2:]

    def of(self, left_out: int) -> tuple[float, float, np.ndarray]:
        """Texts, positives and the positives' mean features without a fold (-1: of all)."""
        keep = np.arange(FOLDS) != left_out
        n_pos = self.n_pos[keep].sum()
        return self.n[keep].sum(), n_pos, (self.positives[keep].sum(0) / max(1.0, n_pos) - self.mean) / self.scale


def _newton(table: DataFrame, at: _Scale, prior: float, models: list[tuple[float, int]]) -> list[np.ndarray]:
    """Standardised weights of all models (ridge, fold left out), fitted in the same passes."""
    weights = []
    for _ in models:
        w = np.zeros(N)
        w[0] = math.log(prior / (1 - prior))
        weights.append(w)
    open_ = list(range(len(models)))
    for _ in range(STEPS):
        got = _total(table, _curves([(weights[j], models[j][1]) for j in open_], at.mean, at.scale), len(open_) * (2 + 2 * N + N * N)).reshape(len(open_), -1)
        still = []
        for j, c in zip(open_, got, strict=True):
            ridge, left_out = models[j]
            n, n_pos, pos_mean = at.of(left_out)
            negative = c[0] / n - prior * c[1] / n_pos
            up, uu = c[2 : 2 + N] / n, c[2 + N : 2 + 2 * N] / n_pos
            hess = c[2 + 2 * N :].reshape(N, N) / n
            penalty = ridge * np.eye(N)
            penalty[0, 0] = 1e-9
            grad = up - prior * pos_mean + penalty @ weights[j] if negative >= 0 else BACK * (prior * uu - up)
            step = np.linalg.solve(hess + penalty + 1e-6 * np.eye(N), grad)
            size = np.linalg.norm(step)
            weights[j] = weights[j] - step * min(1.0, 4.0 / max(size, 1e-12))
            if size >= 1e-5:
                still.append(j)
        open_ = still
        if not open_:
            break
    return weights


def estimate_prior(table: DataFrame, at: _Scale) -> float:
    """The class prior from P and U; see the module text."""
    models = [(RIDGES[-1], k) for k in (range(FOLDS) if all(at.n_pos >= 1) else [-1])]
    fitted = [(w, k) for w, (_, k) in zip(_newton(table, at, SMALL_PRIOR, models), models, strict=True)]
    got = _total(table, _levels(fitted, at.mean, at.scale), 2 * LEVELS)
    u, p = np.cumsum(got[:LEVELS][::-1]), np.cumsum(got[LEVELS:][::-1])
    kept = p >= LEAST_KEPT * p[-1]
    return float(np.clip((u[kept] / u[-1] / (p[kept] / p[-1])).min(), 0.01, 0.99))


def choose_ridge(table: DataFrame, at: _Scale, prior: float) -> tuple[float, np.ndarray]:
    """The penalty with the least risk on folds not seen, and the weights it gives over all rows; of equals the larger one."""
    several = all(at.n_pos >= 1) and all(at.n >= 1)
    models = [(r, k) for r in RIDGES for k in ([-1, *range(FOLDS)] if several else [-1])]
    weights = dict(zip(models, _newton(table, at, prior, models), strict=True))
    if not several:
        return RIDGES[-1], weights[RIDGES[-1], -1]
    tried = [m for m in models if m[1] >= 0]
    got = _total(table, _losses([(weights[m], m[1]) for m in tried], at.mean, at.scale), 3 * len(tried)).reshape(-1, 3)
    risk = dict.fromkeys(RIDGES, 0.0)
    for (r, k), (u, pn, pp) in zip(tried, got, strict=True):
        risk[r] += prior * pp / at.n_pos[k] + max(0.0, u / at.n[k] - prior * pn / at.n_pos[k])
    best = min(RIDGES, key=lambda r: (risk[r], -r))
    return best, weights[best, -1]


def fit(table: DataFrame, prior: float | None = None) -> np.ndarray:
    """Weights over raw features for a table (x, positive, fold); see the module text."""
    at = _Scale(table)
    if not at.n.sum() or not at.n_pos.sum():
        return np.zeros(N)
    w = choose_ridge(table, at, estimate_prior(table, at) if prior is None else prior)[1]
    raw = w / at.scale
    raw[0] = w[0] - float((w[1:] * at.mean[1:] / at.scale[1:]).sum())
    return raw


def _held(col: str):
    """Whether a row is of the held-out part; a null id is not."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 4 == 2, F.lit(False))


def train_weights(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str = "doc_id", label_col: str = "quality") -> tuple[np.ndarray, DataFrame]:
    """Weights, and the table (doc_id, x) of the features of all rows."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = materialize(narrow.mapInArrow(_feature_rows, "doc_id long, x array<float>"), "pu-features")
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & ~_held("id"))
    positives = known.groupBy("id").agg(F.max("label").alias("label")).where("label = 1").select("id")
    fold = F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold")
    marked = table.join(positives.withColumn("hit", F.lit(True)), F.col("doc_id") == F.col("id"), "left").select("x", F.coalesce("hit", F.lit(False)).alias("positive"), fold)
    marked = materialize(marked, "pu-marked")
    w = fit(marked)
    discard(marked)
    return w, table


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", cut: float = 0.7) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Only labels of rows with ``crc32(doc_id) mod 4 <> 2`` are learnt from.
    """
    w, table = train_weights(docs, labels, id_col, text_col, label_id, label_col)
    z = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    score = 1 / (1 + F.exp(-z))
    return table.select("doc_id", _held("doc_id").alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", cut: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score of ``cut`` or more, all columns kept. Texts are judged where they stand, without a join.

    A null text is judged as an empty one; repeated rows are judged alike; without positive labels every
    score is 0.5; an empty table gives no rows; columns of any names pass as they are.
    """
    w, table = train_weights(docs, labels, id_col, text_col, label_id, label_col)
    discard(table)
    least, at = math.log(cut / (1 - cut)), docs.columns.index(text_col)

    def run(batches):
        for batch in sliced(batches):
            x = np.array([features(t) for t in batch.column(at).to_pylist()], np.float32).reshape(-1, N).astype(np.float64)
            yield batch.filter(pa.array(x @ w >= least))

    return docs.mapInArrow(run, docs.schema)
