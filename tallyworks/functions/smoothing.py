"""Exponential smoothing of one short series, many parameter sets at once (NumPy, runs inside Spark tasks).

One-step errors are linear in the starting states. For given weights the best states are therefore a small least-squares
problem, solved exactly; what is searched are the two or three weights, each judged with the states that suit it best.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np

# Coarse grids; then per parameter the first step of the finer search and the limits.
HOLT_GRID = ((0.05, 0.2, 0.4, 0.65, 0.9), (0.0, 0.05, 0.2, 0.6), (0.82, 0.92, 0.98))
HOLT_REACH = ((0.1, 0.001, 0.999), (0.08, 0.0, 0.999), (0.03, 0.8, 0.995))
WINTERS_GRID = ((0.05, 0.2, 0.4, 0.75), (0.0, 0.05, 0.2), (0.0, 0.1, 0.3, 0.6))
WINTERS_REACH = ((0.1, 0.001, 0.999), (0.04, 0.0, 0.999), (0.1, 0.0, 0.999))
# The finer search ends where its step is this part of the first one, or after so many rounds.
LEAST_STEP, MOST_ROUNDS = 1e-3, 60
RIDGE = 1e-10


def holt(y: np.ndarray, p: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Damped trend for every row (alpha, beta, phi) of ``p``: states after the last point, one-step errors of all points.

    ``starts`` has a row (level, trend) for each of ``p``, the states before the first point; so have the states returned.
    """
    alpha, beta, phi = p.T
    level, trend = starts.T
    errors = np.empty((len(y), len(p)))
    for t in range(len(y)):
        drift = phi * trend
        error = y[t] - level - drift
        errors[t] = error
        level = level + drift + alpha * error
        trend = drift + alpha * beta * error
    return np.column_stack([level, trend]), errors


def holt_start(y: np.ndarray, phi: float) -> np.ndarray:
    """States that make the first value the first level and the first difference the first trend, without an error."""
    return np.array([2 * y[0] - y[1], (y[1] - y[0]) / phi])


def winters(y: np.ndarray, p: np.ndarray, starts: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`holt` with additive trend and season and rows (alpha, beta, gamma); states are level, trend and the
    season of the next ``period`` points."""
    alpha, beta, gamma = p.T
    level, trend, season = starts[:, 0], starts[:, 1], starts[:, 2:].T.copy()
    errors = np.empty((len(y), len(p)))
    for t in range(len(y)):
        base, old = level + trend, season[t % period].copy()
        error = y[t] - base - old
        errors[t] = error
        level = base + alpha * error
        trend = trend + alpha * beta * error
        season[t % period] = old + gamma * error
    turn = len(y) % period
    return np.column_stack([level, trend, np.roll(season, -turn, axis=0).T]), errors


def winters_start(y: np.ndarray, period: int) -> np.ndarray:
    """The mean of the first period, the mean step to the second, and the first period's distances."""
    first = y[:period].mean()
    return np.concatenate([[first, (y[period : 2 * period].mean() - first) / period], y[:period] - first])


def winters_basis(period: int) -> np.ndarray:
    """What the starting states of a season may be: a level, a trend, and seasons that add up to 0."""
    season = np.eye(period)[:, 1:] - np.eye(period)[:, :1]
    basis = np.zeros((2 + period, 1 + period))
    basis[0, 0] = basis[1, 1] = 1.0
    basis[2:, 2:] = season
    return basis


def best_starts(run: Callable, y: np.ndarray, p: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``p`` the starting states, combinations of ``basis``, of least squared error, and that error."""
    states, free = basis.shape
    _, errors = run(y, p, np.zeros((len(p), states)))
    # What a unit of each free state adds to the errors, all in one run.
    lanes = np.repeat(p, free, axis=0)
    _, moved = run(np.zeros(len(y)), lanes, np.tile(basis.T, (len(p), 1)))
    moved = moved.T.reshape(len(p), free, len(y))
    gram = moved @ moved.transpose(0, 2, 1)
    gram += np.eye(free) * (RIDGE * np.trace(gram, axis1=1, axis2=2) / free + 1e-300)[:, None, None]
    x = -np.linalg.solve(gram, moved @ errors.T[:, :, None])
    left = errors.T + (moved * x).sum(1)
    return x[:, :, 0] @ basis.T, (left * left).sum(1)


def search(cost_of: Callable[[np.ndarray], np.ndarray], grid, reach) -> np.ndarray:
    """Parameters of least cost: the best of a coarse grid, then of its neighbours, nearer ones once none is better."""
    reach = np.array(reach)
    points = np.array(list(product(*grid)))
    steps = np.array(list(product((-1.0, 0.0, 1.0), repeat=len(reach))))
    best, least, zoom = None, np.inf, 1.0
    for _ in range(MOST_ROUNDS):
        costs = cost_of(points)
        at = int(np.argmin(costs))
        if costs[at] < least:
            best, least = points[at], costs[at]
        elif best is not None:
            zoom /= 2
        if zoom < LEAST_STEP:
            break
        points = np.unique(np.clip(best + steps * reach[:, 0] * zoom, reach[:, 1], reach[:, 2]), axis=0)
    return best


def _fitted(run, y, basis, grid, reach) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, states after the last point and errors of the best fit."""
    scale = float(np.abs(y).max()) or 1.0
    z = y / scale
    best = search(lambda p: best_starts(run, z, p, basis)[1], grid, reach)
    starts, _ = best_starts(run, z, best[None, :], basis)
    states, errors = run(z, best[None, :], starts)
    return best, states[0] * scale, errors[:, 0] * scale


def fit_holt(y: np.ndarray, weights=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, beta, phi), (level, trend) and errors, weights and starting states fitted together; given ``weights`` start
    from the data. Needs two points."""
    if weights is None:
        return _fitted(holt, y, np.eye(2), HOLT_GRID, HOLT_REACH)
    p = np.array([weights], dtype=float)
    states, errors = holt(y, p, holt_start(y, p[0, 2])[None, :])
    return p[0], states[0], errors[:, 0]


def fit_winters(y: np.ndarray, period: int, weights=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, beta, gamma), (level, trend, season) and errors, as :func:`fit_holt`. Needs two periods."""

    def run(y, p, starts):
        return winters(y, p, starts, period)

    if weights is None:
        return _fitted(run, y, winters_basis(period), WINTERS_GRID, WINTERS_REACH)
    p = np.array([weights], dtype=float)
    states, errors = run(y, p, winters_start(y, period)[None, :])
    return p[0], states[0], errors[:, 0]
