"""The objective: log-likelihood, gradient and Hessian as one partition-parallel aggregation, and the penalty.

Maximised: f = sum w ln p_c, p the softmax of the K blocks' scores.  Each
partition gives one packed partial; of more than FEW, groups of about the square
root of their number are added on the cluster, then the sums, one after another in
partition order, so a task holds two of them, the driver gets one, and sums do
not depend on timing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .layout import Layout, dense_columns
from .reduce import in_tree


#: So many partials at most are added in one step.
FEW = 16


@dataclass
class Eval:
    """Value, gradient and Hessian at x; g and h are None where not asked for."""

    x: np.ndarray
    f: float
    g: np.ndarray | None = None
    h: np.ndarray | None = None

    def __add__(self, o: Eval) -> Eval:
        both = lambda a, b: None if a is None or b is None else a + b
        return Eval(self.x, self.f + o.f, both(self.g, o.g), both(self.h, o.h))


    def pack(self) -> np.ndarray:
        """f, the gradient and the upper triangle of the Hessian as one vector."""
        none = np.zeros(0)
        return np.concatenate([[self.f], none if self.g is None else self.g, none if self.h is None else self.h[np.triu_indices(len(self.h))]])

    @staticmethod
    def unpack(x: np.ndarray, packed: np.ndarray, grad: bool, hess: bool) -> Eval:
        """Reads back what `pack` wrote."""
        n, h = len(x), None
        if hess:
            h = np.zeros((n, n))
            h[np.triu_indices(n)] = packed[1 + n * grad :]
            h = h + np.triu(h, 1).T
        return Eval(np.asarray(x, float), float(packed[0]), packed[1 : 1 + n] if grad else None, h)


def design(num: np.ndarray, cat: np.ndarray, dense: list[int], width: int) -> np.ndarray:
    """Dense rows of the layout's columns."""
    x = np.zeros((len(num), width))
    if dense:
        x[:, dense] = num
    if cat.size:
        r, k = np.nonzero(cat >= 0)
        x[r, cat[r, k]] = 1.0
    return x


def fast_exp(x: np.ndarray) -> np.ndarray:
    """About e^x: 2^floor(t) (1 + t - floor(t)) for t = x / ln 2, written straight into a double's bits; 0 to 6.2 % too large.

    Below 2^-1022 it is 0, above the largest double infinite; NaN stays.
    """
    t = np.asarray(x, float) / np.log(2.0)
    bits = (np.clip(np.nan_to_num(t), -1022, 1023) + 1023) * 2.0**52
    out = bits.astype(np.int64).view(float)
    return np.where(np.isnan(t), np.nan, np.where(t < -1022, 0.0, np.where(t >= 1024, np.inf, out)))


def batch_terms(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray, grad: bool, hess: bool, exp=np.exp) -> tuple[float, np.ndarray, np.ndarray]:
    """f, g and H of some rows; beta is K x d."""
    k, d = beta.shape
    s = x @ beta.T
    s -= s.max(1, keepdims=True)
    e = exp(s)
    total = e.sum(1)
    z = np.log(total)
    f = float((w * (s[np.arange(len(y)), y] - z)).sum())
    g, h = np.zeros(k * d if grad else 0), np.zeros((k * d, k * d) if hess else (0, 0))
    if grad or hess:
        p = e / total[:, None]
        if grad:
            r = -p * w[:, None]
            r[np.arange(len(y)), y] += w
            g = (r.T @ x).ravel()
        if hess:
            for a in range(k):
                for b in range(a, k):
                    m = -(x * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
                    h[a * d : a * d + d, b * d : b * d + d] = m
                    h[b * d : b * d + d, a * d : a * d + d] = m.T
    return f, g, h


class DataObjective:
    """The data term over an encoded DataFrame (see `encode`); each evaluation is one Spark job.

    approximate: with `fast_exp`, whose value and gradient do not fit each other exactly.
    """

    def __init__(self, encoded: DataFrame, layout: Layout, approximate: bool = False):
        self.exp = fast_exp if approximate else np.exp
        self.rows, self.layout = encoded.where("category >= 0 and weight > 0"), layout
        parts = encoded.rdd.getNumPartitions()
        self.groups = math.isqrt(parts) if parts > FEW else 1

    @property
    def dims(self) -> int:
        return self.layout.dims

    def __call__(self, x: np.ndarray, grad: bool = True, hess: bool = True) -> Eval:
        spark, lay = self.rows.sparkSession, self.layout
        k, d, dense = len(lay.outcomes), lay.width, dense_columns(lay)
        beta, exp = spark.sparkContext.broadcast(np.asarray(x, float).reshape(k, d)), self.exp

        def run(batches):
            from pyspark import TaskContext

            f, g, h = 0.0, np.zeros(k * d if grad else 0), np.zeros((k * d, k * d) if hess else (0, 0))
            for b in batches:
                n = b.num_rows
                if n:
                    num = np.asarray(b.column("num").flatten(), float).reshape(n, -1)
                    cat = np.asarray(b.column("cat").flatten(), np.int64).reshape(n, -1)
                    y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("category", "weight"))
                    step = max(256, 4_000_000 // max(d, 1))
                    for i in range(0, n, step):
                        j = slice(i, i + step)
                        a, bb, c = batch_terms(design(num[j], cat[j], dense, d), y[j], w[j], beta.value, grad, hess, exp)
                        f, g, h = f + a, g + bb, h + c
            packed = Eval(x, f, g if grad else None, h if hess else None).pack()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([packed.tolist()], pa.list_(pa.float64()))], names=["part", "v"])

        def add(batches):
            first, total = None, None
            for b in batches:
                for p, v in zip(b.column("part").to_pylist(), b.column("v"), strict=True):
                    first, total = (p, np.array(v.values)) if total is None else (first, total + np.asarray(v.values))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "v"])

        out = self.rows.select("category", "weight", "num", "cat").mapInArrow(run, "part int, v array<double>")
        row = in_tree(out, self.groups, add).first()
        total = None if row is None else np.asarray(row[1])
        beta.destroy()
        if total is None:
            total = np.zeros(1 + (k * d) * grad + (k * d * (k * d + 1) // 2) * hess)
        return Eval.unpack(np.asarray(x, float), total, grad, hess)


class NormPenalty:
    """-lambda times the sum of squares; mask: which coefficients count (None: all)."""

    def __init__(self, dims: int, strength: float, mask: np.ndarray | None = None):
        self.dims, self.strength = dims, strength
        self.mask = np.ones(dims) if mask is None else np.asarray(mask, float)

    def __call__(self, x: np.ndarray, grad: bool = True, hess: bool = True) -> Eval:
        x = np.asarray(x, float)
        m = self.strength * self.mask
        return Eval(x, float(-(m * x * x).sum()), -2 * m * x if grad else None, np.diag(-2 * m) if hess else None)


def all_but_const(layout: Layout) -> np.ndarray:
    """The default mask: intercepts of every outcome are free."""
    one = np.ones(layout.width)
    for s in layout.slots:
        if s.kind == "const":
            one[s.start] = 0.0
    return np.tile(one, len(layout.outcomes))


class SumFn:
    def __init__(self, *terms):
        self.terms, self.dims = terms, terms[0].dims

    def __call__(self, x: np.ndarray, grad: bool = True, hess: bool = True) -> Eval:
        out = self.terms[0](x, grad, hess)
        for t in self.terms[1:]:
            out = out + t(x, grad, hess)
        return out
