"""Solvers of mean loss plus penalty that see the rows only through sums: value, gradient and, where asked, curvature.

An Objective makes one pass over the rows for each point that it is asked about, whatever the solver; for squared errors a
single Gram matrix answers all. The first coefficient is the intercept, which no penalty touches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.losses import Loss, Squared, get_loss
from ..functions.penalties import NoPenalty, Penalty
from ..plans import gram, linear


class Objective:
    """The smooth part at a point: mean loss, its gradient, and the mean expected curvature."""

    def __init__(self, df: DataFrame, y: str, x: Sequence[str], loss: str | Loss = "squared_error", weight: str | None = None):
        self.loss = get_loss(loss) if isinstance(loss, str) else loss
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        self.rows = df.select(F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)], w.alias("w")).na.drop()
        self.terms = [F.lit(1.0), *[F.col(f"x{i}") for i in range(len(x))]]
        self.p, self.seen, self.passes = len(x) + 1, {}, 0
        self.whole = None
        if isinstance(self.loss, Squared):
            g = gram(self.rows, [*self.terms, F.col("y")], F.col("w"))
            self.whole, self.passes = g / g[0, 0], 1
        else:
            self.rows = self.rows.persist()  # read at each point; spills to disk where memory is short

    def at(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if self.whole is not None:
            a, b = self.whole[: self.p, : self.p], self.whole[: self.p, self.p]
            return 0.5 * (self.whole[self.p, self.p] - 2 * b @ beta + beta @ a @ beta), a @ beta - b, a
        key = beta.tobytes()
        if key not in self.seen:
            self.passes += 1
            y, e, w = F.col("y"), F.col("e"), F.col("w")
            d = self.rows.withColumn("e", linear(self.terms, beta)).withColumn("h", self.loss.weight(y, e))
            # the weighted Gram of (1, x, slope / h, loss / h, 1 / h) holds all three
            g = gram(d, [*self.terms, self.loss.slope(y, e) / F.col("h"), self.loss.value(y, e) / F.col("h"), 1 / F.col("h")], w * F.col("h"))
            n = g[0, self.p + 2]
            self.seen = {key: (g[0, self.p + 1] / n, g[: self.p, self.p] / n, g[: self.p, : self.p] / n)}  # the last point alone
        return self.seen[key]

    def largest_curvature(self, beta: np.ndarray) -> float:
        return float(np.linalg.eigvalsh(self.at(beta)[2])[-1])


def _prox(penalty: Penalty, z: np.ndarray, step: float) -> np.ndarray:
    out = z.copy()
    out[1:] = penalty.prox(z[1:], step)
    return out


def _smooth(o: Objective, penalty: Penalty, beta: np.ndarray) -> tuple[float, np.ndarray]:
    """Value and gradient of the loss with a smooth penalty."""
    if not penalty.smooth:
        raise ValueError("this solver takes smooth penalties (none, l2) only")
    value, g, _ = o.at(beta)
    return value + penalty.value(beta[1:]), g + np.concatenate([[0.0], penalty.curvature(beta[1:]) * beta[1:]])


def fista(o: Objective, penalty: Penalty, steps: int = 1000, tol: float = 1e-8, start: np.ndarray | None = None) -> np.ndarray:
    """Accelerated proximal gradient steps with backtracking, restarted when the value rises."""
    x = np.zeros(o.p) if start is None else np.asarray(start, float)
    y, t, last, size = x, 1.0, np.inf, max(o.largest_curvature(x), 1e-12)
    for _ in range(steps):
        value, g, _ = o.at(y)
        while True:
            step = min(1 / size, penalty.most_step)
            new = _prox(penalty, y - step * g, step)
            d = new - y
            after = o.at(new)[0]
            if after <= value + g @ d + d @ d / (2 * step) + 1e-14 * abs(value) or size > 1e12:
                break
            size *= 2
        total = after + penalty.value(new[1:])
        if total > last + 1e-14 * abs(last) and penalty.convex:
            y, t, last = x, 1.0, np.inf
            continue
        moved = np.abs(new - x).max()
        more = (1 + np.sqrt(1 + 4 * t * t)) / 2 if penalty.convex else 1.0
        y, x, t, last = new + ((t - 1) / more if penalty.convex else 0.0) * (new - x), new, more, total
        if moved <= tol * (1 + np.abs(x).max()):
            break
    return x


def fista_bb(o: Objective, penalty: Penalty, steps: int = 1000, tol: float = 1e-8, start: np.ndarray | None = None) -> np.ndarray:
    """Proximal gradient steps as long as the last change of the gradient over that of the point (Barzilai and Borwein), cut
    back until the value doesn't rise over the largest of the last few."""
    x = np.zeros(o.p) if start is None else np.asarray(start, float)
    value, g, _ = o.at(x)
    step, recent = 1 / max(o.largest_curvature(x), 1e-12), [value + penalty.value(x[1:])]
    base = step
    for _ in range(steps):
        while True:
            step = min(step, penalty.most_step)
            new = _prox(penalty, x - step * g, step)
            after, ga, _ = o.at(new)
            if after + penalty.value(new[1:]) <= max(recent) - 1e-4 / (2 * step) * ((new - x) ** 2).sum() + 1e-14 * abs(value) or step < base * 1e-6:
                break
            step /= 2
        s, d = new - x, ga - g
        x, g, value = new, ga, after
        recent = [*recent[-9:], value + penalty.value(x[1:])]
        if np.abs(s).max() <= tol * (1 + np.abs(x).max()):
            break
        step = float(np.clip(s @ s / max(s @ d, 1e-300), base * 1e-3, base * 1e3))
    return x


def newton(o: Objective, penalty: Penalty, steps: int = 100, tol: float = 1e-10, start: np.ndarray | None = None) -> np.ndarray:
    """Newton's steps with Armijo's rule; the curvature has 1e-10 added."""
    x = np.zeros(o.p) if start is None else np.asarray(start, float)
    for _ in range(steps):
        value, g = _smooth(o, penalty, x)
        h = o.at(x)[2] + np.diag(np.concatenate([[0.0], penalty.curvature(x[1:])])) + 1e-10 * np.eye(o.p)
        d, size = -np.linalg.solve(h, g), 1.0
        while _smooth(o, penalty, x + size * d)[0] > value + 1e-4 * size * (g @ d) + 1e-14 * abs(value) and size > 1e-8:
            size /= 2
        x = x + size * d
        if np.abs(size * d).max() <= tol * (1 + np.abs(x).max()):
            break
    return x


def proximal_newton(o: Objective, penalty: Penalty, steps: int = 50, tol: float = 1e-9, start: np.ndarray | None = None) -> np.ndarray:
    """Each step minimizes the loss's parabola plus the penalty, then is halved until the objective falls."""
    from ..functions.penalties import solve_quadratic

    x = np.zeros(o.p) if start is None else np.asarray(start, float)
    for _ in range(steps):
        value, g, h = o.at(x)
        h = h + 1e-10 * np.eye(o.p)
        d, size, total = solve_quadratic(h, h @ x - g, penalty, (0,), x) - x, 1.0, value + penalty.value(x[1:])
        while (o.at(x + size * d)[0] + penalty.value((x + size * d)[1:])) > total + 1e-12 * abs(total) and size > 1e-8:
            size /= 2
        x = x + size * d
        if np.abs(size * d).max() <= tol * (1 + np.abs(x).max()):
            break
    return x


def lbfgs(o: Objective, penalty: Penalty, steps: int = 100, tol: float = 1e-9, start: np.ndarray | None = None, history: int = 10, lower: Sequence[float] | None = None, upper: Sequence[float] | None = None) -> np.ndarray:
    """Limited-memory quasi-Newton steps. With bounds, places held by a bound that the gradient pushes against stay, and steps
    are cut off at the box."""
    low = np.full(o.p, -np.inf) if lower is None else np.asarray(lower, float)
    high = np.full(o.p, np.inf) if upper is None else np.asarray(upper, float)
    x = np.clip(np.zeros(o.p) if start is None else np.asarray(start, float), low, high)
    value, g = _smooth(o, penalty, x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        q, used = np.where(free, g, 0.0), []
        if np.abs(q).max(initial=0) <= tol:
            break
        for s, d in reversed(pairs):
            a = s @ q / (s @ d)
            q, used = q - a * d, [a, *used]
        if pairs:
            s, d = pairs[-1]
            q = q * (s @ d) / (d @ d)
        else:
            q = q / max(np.linalg.norm(g), 1.0)
        for (s, d), a in zip(pairs, used, strict=True):
            q = q + s * (a - d @ q / (s @ d))
        step = -np.where(free, q, 0.0)
        if step @ g >= 0:
            step, pairs = -np.where(free, g, 0.0), []
        size = 1.0
        while True:
            new = np.clip(x + size * step, low, high)
            after, ga = _smooth(o, penalty, new)
            if after <= value + 1e-4 * (g @ (new - x)) + 1e-14 * abs(value) or size < 1e-10:
                break
            size /= 2
        s, d = new - x, ga - g
        if s @ d > 1e-12 * np.linalg.norm(s) * np.linalg.norm(d):
            pairs = [*pairs[-(history - 1) :], (s, d)]
        x, value, g = new, after, ga
        if np.abs(s).max() <= tol * 1e-3 * (1 + np.abs(x).max()):
            break
    return x


def admm(o: Objective, penalty: Penalty, steps: int = 500, tol: float = 1e-9, rho: float = 1.0, start: np.ndarray | None = None) -> np.ndarray:
    """The loss and the penalty are minimized in turn on copies that are drawn together; rho follows the two residuals.

    The loss's part is one Newton step from the copy for squared errors, and a few for others.
    """
    z = np.zeros(o.p) if start is None else np.asarray(start, float)
    x, u = z.copy(), np.zeros(o.p)
    for _ in range(steps):
        for _ in range(1 if o.whole is not None else 5):
            _, g, h = o.at(x)
            d = -np.linalg.solve(h + rho * np.eye(o.p), g + rho * (x - z + u))
            x = x + d
            if np.abs(d).max() <= tol * 0.1:
                break
        before, z = z, _prox(penalty, x + u, min(1 / rho, penalty.most_step))
        u = u + x - z
        primal, dual = np.abs(x - z).max(), rho * np.abs(z - before).max()
        if max(primal, dual) <= tol * (1 + np.abs(z).max()):
            break
        if primal > 10 * dual:
            rho, u = rho * 2, u / 2
        elif dual > 10 * primal:
            rho, u = rho / 2, u * 2
    return z


def irls(o: Objective, penalty: Penalty, steps: int = 100, tol: float = 1e-10, start: np.ndarray | None = None, penalty_matrix: np.ndarray | None = None) -> np.ndarray:
    """Reweighted least squares; a penalty matrix adds b'Sb / 2 to the mean loss."""
    s = np.zeros((o.p, o.p)) if penalty_matrix is None else penalty_matrix
    x = np.zeros(o.p) if start is None else np.asarray(start, float)
    for _ in range(steps):
        _, g, h = o.at(x)
        ridge = s + np.diag(np.concatenate([[0.0], penalty.curvature(x[1:])]))
        new = np.linalg.pinv(h + ridge) @ (h @ x - g)
        moved = np.abs(new - x).max()
        x = new
        if moved <= tol * (1 + np.abs(x).max()):
            break
    return x


SOLVERS: dict[str, Callable[..., np.ndarray]] = {"fista": fista, "fista_bb": fista_bb, "newton": newton, "proximal_newton": proximal_newton, "lbfgs": lbfgs, "lbfgs_b": lbfgs, "admm": admm, "irls": irls}


def preferred(loss: Loss, penalty: Penalty) -> str:
    """The solver that takes the fewest passes: Newton's for smooth problems, its proximal form where the loss has a
    curvature, plain proximal steps for concave penalties of other losses."""
    if isinstance(penalty, NoPenalty) or penalty.smooth:
        return "newton" if loss.curved else "irls"
    return "proximal_newton" if loss.curved else "fista_bb"


def solve(df: DataFrame, y: str, x: Sequence[str], loss: str, penalty: Penalty, solver: str = "auto", **how) -> np.ndarray:
    o = Objective(df, y, x, loss)
    name = preferred(o.loss, penalty) if solver == "auto" else solver
    if name in ("newton", "lbfgs", "lbfgs_b", "proximal_newton") and not o.loss.curved:
        raise ValueError(f"{name} needs a loss with curvature")
    try:
        return SOLVERS[name](o, penalty, **how)
    finally:
        o.rows.unpersist()
