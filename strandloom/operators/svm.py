"""Support-vector models: kernels, reading predictions off a model, votes and probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINEAR, POLY, RBF, SIGMOID, PRECOMPUTED = "linear", "polynomial", "rbf", "sigmoid", "precomputed"


@dataclass
class SvmModel:
    """A model as its text format gives it; sv has a row per support vector."""

    svm_type: str = "epsilon_svr"
    kernel: str = RBF
    gamma: float = 0.0
    coef0: float = 0.0
    degree: int = 3
    rho: list[float] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    prob_a: list[float] = field(default_factory=list)
    prob_b: list[float] = field(default_factory=list)
    coef: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    sv: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def kernel_values(x: np.ndarray, model: SvmModel) -> np.ndarray:
    """Kernel of each row of x with each support vector."""
    if model.kernel == PRECOMPUTED:
        return x[:, model.sv[:, 0].astype(int)]
    dots = x @ model.sv.T
    if model.kernel == LINEAR:
        return dots
    if model.kernel == POLY:
        return (model.gamma * dots + model.coef0) ** model.degree
    if model.kernel == RBF:
        return np.exp(-model.gamma * np.maximum((x**2).sum(1)[:, None] + (model.sv**2).sum(1)[None] - 2 * dots, 0))
    return np.tanh(model.gamma * dots + model.coef0)


def decisions(x: np.ndarray, model: SvmModel) -> np.ndarray:
    """Decision values: one a row for regression and one-class models, else one per pair of classes."""
    k = kernel_values(x, model)
    if not model.counts:
        return (k @ model.coef[0] - model.rho[0])[:, None]
    ends = np.cumsum([0, *model.counts])
    out = []
    for i in range(len(model.counts)):
        for j in range(i + 1, len(model.counts)):
            a, b = slice(ends[i], ends[i + 1]), slice(ends[j], ends[j + 1])
            out.append(k[:, a] @ model.coef[j - 1, a] + k[:, b] @ model.coef[i, b] - model.rho[len(out)])
    return np.stack(out, 1)


def votes(values: np.ndarray, model: SvmModel) -> np.ndarray:
    """Label with the most pairwise wins, the first of equals."""
    n, tally, at = len(model.counts), np.zeros((len(values), len(model.counts)), int), 0
    for i in range(n):
        for j in range(i + 1, n):
            won = values[:, at] > 0
            tally[:, i] += won
            tally[:, j] += ~won
            at += 1
    return np.array(model.labels)[tally.argmax(1)]


def probabilities(values: np.ndarray, model: SvmModel, rounds: int = 100) -> np.ndarray:
    """Class probabilities coupled from pairwise sigmoids of the decision values."""
    n = len(model.counts)
    r = np.zeros((len(values), n, n))
    at = 0
    for i in range(n):
        for j in range(i + 1, n):
            p = np.clip(1 / (1 + np.exp(values[:, at] * model.prob_a[at] + model.prob_b[at])), 1e-7, 1 - 1e-7)
            r[:, i, j], r[:, j, i] = p, 1 - p
            at += 1
    # minimise the squared disagreement of p_i r_ji and p_j r_ij with probabilities that sum to one: a system a row
    q = -r.transpose(0, 2, 1) * r
    q[:, np.arange(n), np.arange(n)] = (r**2).sum(axis=1)
    system = np.ones((len(values), n + 1, n + 1))
    system[:, :n, :n], system[:, n, n] = q, 0.0
    out = (np.linalg.pinv(system) @ np.r_[np.zeros(n), 1.0])[:, :n].clip(0)
    return out / out.sum(1, keepdims=True)


def predicted(x: np.ndarray, model: SvmModel) -> np.ndarray:
    """The model's prediction for each row of x: a value, a class or 1 and -1."""
    values = decisions(x, model)
    if model.counts and model.svm_type in ("c_svc", "nu_svc"):
        return votes(values, model).astype(float)
    return np.where(values[:, 0] > 0, 1.0, -1.0) if model.svm_type == "one_class" else values[:, 0]


#: Rows that are multiplied with the support vectors at once.
BLOCK = 2048


def predict(rows: DataFrame, model: SvmModel, features: str = "features", output: str = "prediction") -> DataFrame:
    """rows with the model's prediction for an array column; the model is broadcast once.

    Blocks of rows are multiplied with the matrix of support vectors. A null vector has no prediction; vectors
    are as long as the model's (shorter ones, of which the rest is 0, aren't taken for granted).
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c != output]
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], f"`{output}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in (whole.slice(at, BLOCK) for at in range(0, whole.num_rows, BLOCK)):
                column = batch[features]
                there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                out = np.full(batch.num_rows, np.nan)
                if len(there):
                    x = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(there), -1)
                    out[there] = predicted(x, own)
                values = pa.array(out, mask=~np.isin(np.arange(batch.num_rows), there))
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], values], names=[*kept, output])

    return rows.select(*kept).mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def kernel(a: Column, b: Column, kind: str = RBF, gamma: float = 0.5, coef0: float = 0.0, degree: int = 3) -> Column:
    """Kernel of two array columns as an expression."""
    if kind == RBF:
        squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
        return F.exp(-gamma * F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    if kind == LINEAR:
        return dot(a, b)
    if kind == POLY:
        return F.pow(gamma * dot(a, b) + coef0, F.lit(degree))
    if kind == SIGMOID:
        return F.tanh(gamma * dot(a, b) + coef0)
    raise ValueError(f"no kernel {kind} of two vectors")


def fit_sigmoid(decision: np.ndarray, positive: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """A and B of 1 / (1 + exp(A f + B)), by Newton steps on smoothed targets."""
    n_pos, n_neg = int(positive.sum()), int((~positive).sum())
    target = np.where(positive, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    a, b = 0.0, float(np.log((n_neg + 1) / (n_pos + 1)))
    x = np.stack([decision, np.ones_like(decision)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(a * decision + b, -500, 500)))
        gradient = x.T @ (target - p)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-12 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(gradient).max() < 1e-5:
            break
    return float(a), float(b)
