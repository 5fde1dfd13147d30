"""Penalties on a vector of coefficients: value, proximal map, weights of a linear approximation, curvature, and a registry.

They work on driver vectors, whose length is the number of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def _soft(z: np.ndarray, t: np.ndarray | float) -> np.ndarray:
    return np.sign(z) * np.maximum(np.abs(z) - t, 0)


class Penalty:
    """What a penalty answers. convex tells whether accelerated steps are safe; most_step bounds a proximal step's size."""

    convex, smooth = True, False
    most_step = np.inf

    def value(self, b: np.ndarray) -> float:
        raise NotImplementedError

    def prox(self, z: np.ndarray, step: float) -> np.ndarray:
        """The b that minimizes (b - z)^2 / 2 + step * value(b)."""
        raise NotImplementedError

    def weights(self, b: np.ndarray) -> np.ndarray:
        """Slopes of the penalty in |b|: the weighted absolute values that lie over it and touch it at b."""
        raise NotImplementedError

    def curvature(self, b: np.ndarray) -> np.ndarray:
        return np.zeros(len(b))


class NoPenalty(Penalty):
    smooth = True

    def value(self, b):
        return 0.0

    def prox(self, z, step):
        return z

    def weights(self, b):
        return np.zeros(len(b))


class L1(Penalty):
    def __init__(self, alpha: float = 1.0, weight: Sequence[float] | float = 1.0):
        self.alpha, self.weight = alpha, np.asarray(weight, float)

    def value(self, b):
        return float((self.alpha * self.weight * np.abs(b)).sum())

    def prox(self, z, step):
        return _soft(z, step * self.alpha * self.weight)

    def weights(self, b):
        return self.alpha * self.weight * np.ones(len(b))


class AdaptiveL1(L1):
    """Weights 1 / (|start| + eps)^nu, scaled to a mean of 1."""

    def __init__(self, alpha: float = 1.0, start: Sequence[float] = (), nu: float = 1.0, eps: float = 1e-8, normalize: bool = True):
        w = 1 / (np.abs(np.asarray(start, float)) + eps) ** nu
        super().__init__(alpha, w / w.mean() if normalize and len(w) else w)


class L2(Penalty):
    smooth = True

    def __init__(self, alpha: float = 1.0):
        self.alpha = alpha

    def value(self, b):
        return 0.5 * self.alpha * float(b @ b)

    def prox(self, z, step):
        return z / (1 + step * self.alpha)

    def weights(self, b):
        return self.alpha * np.abs(b)

    def curvature(self, b):
        return np.full(len(b), self.alpha)


class ElasticNet(Penalty):
    def __init__(self, alpha: float = 1.0, l1_ratio: float = 0.5):
        self.alpha, self.l1_ratio = alpha, l1_ratio

    def value(self, b):
        return self.alpha * float(self.l1_ratio * np.abs(b).sum() + 0.5 * (1 - self.l1_ratio) * (b @ b))

    def prox(self, z, step):
        return _soft(z, step * self.alpha * self.l1_ratio) / (1 + step * self.alpha * (1 - self.l1_ratio))

    def weights(self, b):
        return self.alpha * (self.l1_ratio + (1 - self.l1_ratio) * np.abs(b))

    def curvature(self, b):
        return np.full(len(b), self.alpha * (1 - self.l1_ratio))


class Scad(Penalty):
    convex = False

    def __init__(self, alpha: float = 1.0, a: float = 3.7):
        self.alpha, self.a, self.most_step = alpha, a, 0.9 * (a - 1)

    def value(self, b):
        x, l, a = np.abs(b), self.alpha, self.a
        return float(np.where(x <= l, l * x, np.where(x <= a * l, (2 * a * l * x - x * x - l * l) / (2 * (a - 1)), l * l * (a + 1) / 2)).sum())

    def prox(self, z, step):
        x, l, a = np.abs(z), self.alpha, self.a
        return np.where(x <= l * (1 + step), _soft(z, step * l), np.where(x <= a * l, ((a - 1) * z - np.sign(z) * a * l * step) / (a - 1 - step), z))

    def weights(self, b):
        x, l = np.abs(b), self.alpha
        return np.where(x <= l, l, np.maximum(self.a * l - x, 0) / (self.a - 1))

    def curvature(self, b):
        x, l = np.abs(b), self.alpha
        return np.where((x > l) & (x < self.a * l), -1 / (self.a - 1), 0.0)


class Mcp(Penalty):
    convex = False

    def __init__(self, alpha: float = 1.0, gamma: float = 3.0):
        self.alpha, self.gamma, self.most_step = alpha, gamma, 0.9 * gamma

    def value(self, b):
        x, l, g = np.abs(b), self.alpha, self.gamma
        return float(np.where(x <= g * l, l * x - x * x / (2 * g), g * l * l / 2).sum())

    def prox(self, z, step):
        return np.where(np.abs(z) <= self.gamma * self.alpha, _soft(z, step * self.alpha) / (1 - step / self.gamma), z)

    def weights(self, b):
        return np.maximum(self.alpha - np.abs(b) / self.gamma, 0)

    def curvature(self, b):
        return np.where(np.abs(b) < self.gamma * self.alpha, -1 / self.gamma, 0.0)


class Grouped(Penalty):
    """A penalty on the norms of groups of coefficients. groups: each coefficient's group; the default scale of a group is the
    root of its size."""

    def __init__(self, each: Callable[[float], Penalty], groups: Sequence[int], alpha: float = 1.0, scale: Sequence[float] | None = None):
        ids = np.asarray(groups)
        self.parts = [np.flatnonzero(ids == g) for g in dict.fromkeys(ids.tolist())]
        scale = [np.sqrt(len(p)) for p in self.parts] if scale is None else list(scale)
        self.each = [each(alpha * s) for s in scale]
        self.convex, self.most_step = self.each[0].convex, min(e.most_step for e in self.each)

    def value(self, b):
        return sum(e.value(np.array([np.linalg.norm(b[p])])) for e, p in zip(self.each, self.parts, strict=True))

    def prox(self, z, step):
        out = z.copy()
        for e, p in zip(self.each, self.parts, strict=True):
            size = np.linalg.norm(z[p])
            out[p] = z[p] * (e.prox(np.array([size]), step)[0] / size if size > 0 else 0.0)
        return out

    def weights(self, b):
        out = np.zeros(len(b))
        for e, p in zip(self.each, self.parts, strict=True):
            out[p] = e.weights(np.array([np.linalg.norm(b[p])]))[0]
        return out


class Composite(Penalty):
    """A weighted sum; its proximal map applies the parts' maps one after the other, which is exact for l1 then l2."""

    def __init__(self, penalties: Sequence[Penalty], weights: Sequence[float] | None = None):
        self.penalties, self.scale = list(penalties), [1.0] * len(penalties) if weights is None else list(weights)
        self.convex, self.smooth = all(p.convex for p in penalties), all(p.smooth for p in penalties)

    def value(self, b):
        return sum(w * p.value(b) for w, p in zip(self.scale, self.penalties, strict=True))

    def prox(self, z, step):
        for w, p in zip(self.scale, self.penalties, strict=True):
            z = p.prox(z, step * w)
        return z

    def weights(self, b):
        return sum(w * p.weights(b) for w, p in zip(self.scale, self.penalties, strict=True))

    def curvature(self, b):
        return sum(w * p.curvature(b) for w, p in zip(self.scale, self.penalties, strict=True))


_PENALTIES: dict[str, Callable[..., Penalty]] = {}


def register_penalty(name: str) -> Callable:
    """A decorator that makes a penalty known by name."""

    def put(make: Callable[..., Penalty]) -> Callable[..., Penalty]:
        _PENALTIES[name] = make
        return make

    return put


def get_penalty(name: str, **parameters) -> Penalty:
    if name not in _PENALTIES:
        raise ValueError(f"no penalty {name!r}; there are {', '.join(list_penalties())}")
    return _PENALTIES[name](**parameters)


def list_penalties() -> list[str]:
    return sorted(_PENALTIES)


for _name, _make in (("none", lambda alpha=0.0: NoPenalty()), ("l1", L1), ("l2", L2), ("elasticnet", ElasticNet), ("scad", Scad), ("mcp", Mcp), ("adaptive_l1", AdaptiveL1)):
    register_penalty(_name)(_make)
register_penalty("group_lasso")(lambda alpha=1.0, groups=(): Grouped(L1, groups, alpha))
register_penalty("group_mcp")(lambda alpha=1.0, gamma=3.0, groups=(): Grouped(lambda x: Mcp(x, gamma), groups, alpha))
register_penalty("group_scad")(lambda alpha=1.0, a=3.7, groups=(): Grouped(lambda x: Scad(x, a), groups, alpha))
register_penalty("adaptive_group_lasso")(lambda alpha=1.0, groups=(), weights=None: Grouped(L1, groups, alpha, weights))


def solve_quadratic(a: np.ndarray, b: np.ndarray, penalty: Penalty, free: Sequence[int] = (0,), start: np.ndarray | None = None, steps: int = 20_000, tol: float = 1e-13) -> np.ndarray:
    """The x that minimizes x'ax/2 - b'x + penalty(x without the free places), by proximal gradient steps.

    Columns are scaled so that a's diagonal is 1 where the penalty allows it (it has no other effect than speed for none);
    steps are accelerated, and restarted when the value rises, for convex penalties.
    """
    x = np.zeros(len(b)) if start is None else start.astype(float).copy()
    held = np.setdiff1d(np.arange(len(b)), np.asarray(free, int))
    if isinstance(penalty, NoPenalty | L2):
        ridge = np.zeros(len(b))
        ridge[held] = penalty.curvature(x[held])
        return _pinv_solve(a + np.diag(ridge), b)
    if len(held) < len(b):  # the free places are solved for, which leaves a problem in the others
        f = np.asarray(free, int)
        aff, afh = a[np.ix_(f, f)], a[np.ix_(f, held)]
        inv = np.linalg.pinv(aff)
        inner = solve_quadratic(a[np.ix_(held, held)] - afh.T @ inv @ afh, b[held] - afh.T @ inv @ b[f], penalty, (), x[held], steps, tol)
        out = np.zeros(len(b))
        out[held], out[f] = inner, inv @ (b[f] - afh @ inner)
        return out
    step = min(1 / max(np.linalg.eigvalsh(a)[-1], 1e-300), penalty.most_step)
    y, t, last = x.copy(), 1.0, np.inf
    for _ in range(steps):
        new = penalty.prox(y - step * (a @ y - b), step)
        value = 0.5 * new @ a @ new - b @ new + penalty.value(new)
        if penalty.convex and value > last + 1e-15 * abs(last):
            y, t = x.copy(), 1.0
            last = np.inf
            continue
        moved = np.abs(new - x).max()
        if penalty.convex:
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, t = new + (t - 1) / after * (new - x), after
        else:
            y = new
        x, last = new, value
        if moved <= tol * (1 + np.abs(x).max()):
            break
    return x


def _pinv_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    scaled = a / np.outer(d, d)
    inv = np.linalg.inv(scaled) if np.linalg.eigvalsh(scaled)[0] > 1e-12 else np.linalg.pinv(scaled, rcond=1e-10)
    return (inv / np.outer(d, d)) @ b
