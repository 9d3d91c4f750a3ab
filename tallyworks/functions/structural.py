"""Additive or multiplicative model of trend, sparse changes of trend and yearly season (NumPy, runs inside Spark tasks)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Possible changes of trend, evenly over the first part of the series; waves of the year.
CHANGEPOINTS, CHANGEPOINT_RANGE = 25, 0.8
HARMONICS, PERIOD = 5, 12.0
# Prior deviations of level and slope, and the least noise, in parts of the largest value.
LEVEL_SCALE, LEAST_NOISE = 5.0, 1e-3
DRAWS, SEED, LOW, HIGH = 1000, 42, 0.1, 0.9
ROUNDS, SWEEPS, CLOSE = 30, 20_000, 1e-10


@dataclass
class Structural:
    """Fitted on values divided by ``scale`` at times 0 to 1; ``changes`` of slope at ``knots``."""

    scale: float
    noise: float
    level: float
    slope: float
    changes: np.ndarray
    season: np.ndarray
    knots: np.ndarray
    first_month: int
    length: int
    multiplicative: bool

    def trend(self, t: np.ndarray) -> np.ndarray:
        x = t / max(self.length - 1, 1)
        return self.level + self.slope * x + hinges(x, self.knots) @ self.changes

    def waves(self, t: np.ndarray) -> np.ndarray:
        return waves(t, self.first_month, len(self.season) // 2) @ self.season

    def combined(self, trend: np.ndarray, waves: np.ndarray) -> np.ndarray:
        return self.scale * (trend * (1 + waves) if self.multiplicative else trend + waves)

    def predict(self, t: np.ndarray) -> np.ndarray:
        """Expected values at months ``t`` from the first."""
        return self.combined(self.trend(t), self.waves(t))

    def interval(self, periods: int) -> tuple[np.ndarray, np.ndarray]:
        """Quantiles of what may come: new changes of trend as often and as large as those before, and the noise."""
        rng = np.random.default_rng(SEED)
        t = np.arange(self.length, self.length + periods)
        x, end = t / max(self.length - 1, 1), (self.length + periods - 1) / max(self.length - 1, 1)
        paths = np.repeat(self.trend(t)[None, :], DRAWS, axis=0)
        if len(self.knots) and periods:
            counts = rng.poisson(len(self.knots) * (end - 1), DRAWS)
            at = 1 + rng.random((DRAWS, int(counts.max(initial=0)))) * (end - 1)
            size = rng.laplace(0, np.abs(self.changes).mean() + 1e-8, at.shape) * (np.arange(at.shape[1]) < counts[:, None])
            paths += (np.maximum(x[None, None, :] - at[:, :, None], 0) * size[:, :, None]).sum(1)
        drawn = self.combined(paths, self.waves(t)[None, :]) + self.scale * self.noise * rng.normal(size=paths.shape)
        return np.quantile(drawn, LOW, axis=0), np.quantile(drawn, HIGH, axis=0)


def hinges(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.maximum(x[:, None] - knots[None, :], 0.0)


def waves(t: np.ndarray, first_month: int, harmonics: int) -> np.ndarray:
    phase = 2 * np.pi * (t + first_month) / PERIOD
    return np.column_stack([f(h * phase) for h in range(1, harmonics + 1) for f in (np.sin, np.cos)]) if harmonics else np.zeros((len(t), 0))


def sparse_fit(y, plain, prior, sparse, laplace, noise) -> tuple[np.ndarray, np.ndarray]:
    """Most likely coefficients: normal priors on the columns of ``plain``, one Laplace prior on those of ``sparse``.

    Minimises ``|y - plain b - sparse d|^2 / (2 noise^2) + sum (b / prior)^2 / 2 + sum |d| / laplace``. The best ``b`` for any ``d`` is
    linear in it and put in; what is left is minimised a coordinate of ``d`` at a time.
    """
    gram = plain.T @ plain / noise**2 + np.diag(1 / prior**2)
    solved = np.linalg.solve(gram, plain.T / noise**2)
    weight = (np.eye(len(y)) - plain @ solved) / noise**2
    q, g = sparse.T @ weight @ sparse, sparse.T @ weight @ y
    d = np.zeros(sparse.shape[1])
    pull = np.zeros(len(d))  # q @ d, kept up to date
    spread = np.maximum(np.diag(q), 1e-300)
    for _ in range(SWEEPS if len(d) else 0):
        moved = 0.0
        for j in range(len(d)):
            free = g[j] - pull[j] + spread[j] * d[j]
            new = np.sign(free) * max(abs(free) - 1 / laplace, 0.0) / spread[j]
            step = new - d[j]
            if step:
                pull += q[:, j] * step
                d[j] = new
                moved = max(moved, abs(step) * np.sqrt(spread[j]))
        if moved < CLOSE * (1 + np.sqrt(max(y @ weight @ y, 0.0))):
            break
    return solved @ (y - sparse @ d), d


def fit(y: np.ndarray, last_month: int, changepoint_scale: float = 0.05, season_scale: float = 10.0, multiplicative: bool = False) -> Structural:
    """A monthly series whose last point is of ``last_month`` (1 to 12); no season below a year.

    Noise and coefficients are fitted in turn; with a multiplicative season trend and season are, too.
    """
    n = len(y)
    scale = float(np.abs(y).max()) or 1.0
    z, t = y / scale, np.arange(n)
    x = t / max(n - 1, 1)
    knots = np.linspace(0, CHANGEPOINT_RANGE, min(CHANGEPOINTS, max(n - 2, 0)) + 1)[1:]
    harmonics, first_month = (HARMONICS if n >= PERIOD else 0), last_month - n
    line, bends, round_year = np.column_stack([np.ones(n), x]), hinges(x, knots), waves(t, first_month, harmonics)
    line_prior, year_prior = np.full(2, LEVEL_SCALE), np.full(2 * harmonics, season_scale)
    season, noise, said = np.zeros(2 * harmonics), 0.1, None
    for _ in range(ROUNDS):
        if multiplicative:
            factor = 1 + round_year @ season
            b, d = sparse_fit(z, line * factor[:, None], line_prior, bends * factor[:, None], changepoint_scale, noise)
            trend = line @ b + bends @ d
            if harmonics:
                season = sparse_fit(z - trend, round_year * trend[:, None], year_prior, np.zeros((n, 0)), changepoint_scale, noise)[0]
            now = trend * (1 + round_year @ season)
        else:
            b, d = sparse_fit(z, np.column_stack([line, round_year]), np.concatenate([line_prior, year_prior]), bends, changepoint_scale, noise)
            b, season = b[:2], b[2:]
            now = line @ b + bends @ d + round_year @ season
        noise = max(float(np.sqrt(np.mean((z - now) ** 2))), LEAST_NOISE)
        if said is not None and np.abs(now - said).max() < 1e-7:
            break
        said = now
    return Structural(scale, noise, float(b[0]), float(b[1]), d, season, knots, first_month, n, multiplicative)
