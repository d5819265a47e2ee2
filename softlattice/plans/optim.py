"""Driver-side optimisers and linear solvers; a function f(x, grad, hess) -> Eval costs one Spark job a call."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np

from ..operators.objective import Eval


def solve_default(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares of least norm, so that over-complete layouts pose no problem."""
    return np.linalg.lstsq(a, b, rcond=None)[0]


def solve_direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a, b)


def solve_cholesky(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For definite matrices of either sign; others are solved directly."""
    d = np.diag(a)
    sign = -1.0 if d[np.flatnonzero(d)[:1]].sum() < 0 else 1.0
    try:
        low = np.linalg.cholesky(sign * a)
    except np.linalg.LinAlgError:
        return solve_direct(a, b)
    return np.linalg.solve(low.T, np.linalg.solve(low, sign * b))


def solve_cg(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Conjugate gradients, restarted once; stops at a squared residual of 1e-12."""
    x = np.zeros_like(b, dtype=float)
    for _ in range(2):
        r = b - a @ x
        p, rr = r.copy(), r @ r
        for _ in range(4 * len(b)):
            if rr <= 1e-12:
                return x
            ap = a @ p
            if p @ ap == 0:
                break
            step = rr / (p @ ap)
            x, r = x + step * p, r - step * ap
            now = r @ r
            p, rr = r + now / rr * p, now
    return x


def _gained(new: float, old: float, share: float) -> bool:
    return new - old > max(1.0, abs(new)) * share


def newton(f, x0, max_rounds: int = 20, solver: Callable = solve_default, box: float = 2000.0, gain: float = 1e-4) -> Eval:
    """Maximise by Newton steps with step halving; a failed solve falls back to the gradient."""
    now = f(np.asarray(x0, float), True, True)
    for _ in range(max_rounds):
        if now.g @ now.g <= 1e-8:
            break
        try:
            step = -solver(now.h, now.g)
        except np.linalg.LinAlgError:
            step = now.g / max(1.0, np.abs(now.g).max())
        step = np.where(np.isfinite(step), step, 0.0)
        if step @ now.g < 0:
            step = now.g / max(1.0, np.abs(now.g).max())
        scale, new = 1.0, None
        while scale * np.abs(step).max() > 1e-4:
            x = np.clip(now.x + scale * step, -box, box)
            trial = f(x, True, True) if scale == 1.0 else f(x, False, False)
            if np.isfinite(trial.f) and trial.f > now.f:
                new = trial if trial.g is not None else f(x, True, True)
                break
            scale *= 0.5
        if new is None:
            break
        old, now = now, new
        if not _gained(now.f, old.f, gain):
            break
    return now


class LineFn:
    """f along x + t * direction, clipped to a box; remembers its last 10 values and the best point seen."""

    def __init__(self, f, x, direction, box: float = 1e4):
        self.f, self.x, self.d, self.box = f, np.asarray(x, float), np.asarray(direction, float), box
        self.cache: OrderedDict[float, float] = OrderedDict()
        self.best = (-np.inf, 0.0)

    def point(self, t: float) -> np.ndarray:
        return np.clip(self.x + t * self.d, -self.box, self.box)

    def __call__(self, t: float) -> float:
        if t not in self.cache:
            if len(self.cache) >= 10:
                self.cache.popitem(last=False)
            self.cache[t] = self.f(self.point(t), False, False).f
        self.best = max(self.best, (self.cache[t], t))
        return self.cache[t]


def line_max(f: Callable[[float], float], x0: float, scale: float, max_steps: int = 60) -> float:
    """The maximum of a scalar function: bracket by doubling, then golden sections down to a width of 1e-2 * scale."""
    ratio, best = (5**0.5 - 1) / 2, (f(x0), x0)
    side = 1.0 if f(x0 + scale) >= f(x0 - scale) else -1.0
    low, high, step = x0 - side * scale, x0 + side * scale, scale
    for _ in range(max_steps):
        if f(high) <= best[0]:
            break
        best, step = (f(high), high), 2 * step
        low, high = best[1] - side * step / 2, best[1] + side * step
    a, b = min(low, high), max(low, high)
    u, v = b - ratio * (b - a), a + ratio * (b - a)
    for _ in range(max_steps):
        if b - a <= 1e-2 * abs(scale):
            break
        if f(u) >= f(v):
            b, v = v, u
            u = b - ratio * (b - a)
        else:
            a, u = u, v
            v = a + ratio * (b - a)
    return max(best, (f((a + b) / 2), (a + b) / 2))[1]


def line_min(f: Callable[[float], float], x0: float, scale: float, max_steps: int = 60) -> float:
    return line_max(lambda t: -f(t), x0, scale, max_steps)


def _ascend(f, x0, max_rounds: int, box: float, stop: float, scale, conjugate: bool) -> Eval:
    now = f(np.asarray(x0, float), True, False)
    d = now.g
    for _ in range(max_rounds):
        if now.g @ now.g < stop:
            break
        if d @ d < 1e-12 or d @ now.g <= 0:
            d = now.g
        line = LineFn(f, now.x, d, box)
        line(0.0)
        line_max(line, 0.0, scale(d), 20)
        value, t = line.best
        if t == 0.0 or not value > now.f:
            if d is now.g:
                break
            d = now.g
            continue
        new = f(line.point(t), True, False)
        beta = max(0.0, new.g @ (new.g - now.g) / (now.g @ now.g)) if conjugate else 0.0
        d, old, now = new.g + beta * d, now, new
        if not _gained(now.f, old.f, 1e-3 if not conjugate else 1e-6) or (now.x - old.x) @ (now.x - old.x) < 1e-14:
            break
    return now


def conjugate_gradient(f, x0, max_rounds: int = 100) -> Eval:
    """Polak-Ribiere; maximises."""
    return _ascend(f, x0, max_rounds, 1e10, 1e-20, lambda d: 1e-3, True)


def gradient_ascent(f, x0, max_rounds: int = 100) -> Eval:
    return _ascend(f, x0, max_rounds, 1e4, 1e-12, lambda d: 1 / max(1.0, np.abs(d).max()), False)


def minimised(f):
    """-f as a function to maximise."""

    def g(x, grad=True, hess=True):
        e = f(x, grad, hess)
        return Eval(e.x, -e.f, None if e.g is None else -e.g, None if e.h is None else -e.h)

    return g
