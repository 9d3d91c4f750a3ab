import itertools

import numpy as np
import pytest

from conftest import by, day, make_series, months
from tallyworks.functions import arima as arima_fit, structural as parts
from tallyworks.functions import smoothing as fits
from tallyworks.operators.explore import decompose
from tallyworks.operators.forecast import arima, ensemble, evaluate, linear, scenario, select, smoothing, structural

K = ["name"]


def seasonal(n, seed=0, noise=1.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 100 + t + 20 * np.sin(2 * np.pi * t / 12) + noise * rng.normal(size=n)


@pytest.mark.parametrize("n, last6, ratio", [(4, 3, 4), (5, 4, 4), (6, 4, 5), (11, 5, 9), (12, 6, 10), (80, 74, 64)])
def test_split_sizes(spark, n, last6, ratio):
    rows = make_series(spark, a=range(n))
    trained = lambda df: df.where("split = 'train'").count()
    assert trained(evaluate.split_last(rows, K, 6)) == last6
    assert trained(evaluate.split_ratio(rows, K, 0.2)) == ratio


def test_exact_line_flat_line_and_clipping(spark):
    rows = make_series(spark, up=[3 + 2 * i for i in range(10)], flat=[7] * 10, down=[10 - 2 * i for i in range(6)])
    fit = by(linear.fit_line(rows, K), "name")
    assert fit["up"].slope == pytest.approx(2) and fit["up"].mae == pytest.approx(0, abs=1e-9) and fit["up"].r2 == pytest.approx(1)
    assert [fit[n].trend_direction for n in ("up", "flat", "down")] == ["Increasing", "Stable", "Decreasing"]
    ahead = by(linear.forecast_trend(linear.fit_line(rows, K), K, 2), "name", "step")
    assert ahead["up", 1].forecast == pytest.approx(23) and ahead["up", 1].date == day("2020-11-01")
    assert ahead["down", 2].forecast == 0 and ahead["down", 2].lower_ci == 0
    ends = by(linear.forecast_line(linear.fit_line(rows, K), K, 2), "name", "step")
    assert ends["down", 2].forecast == pytest.approx(-4) and ends["down", 2].date == day("2020-08-31")


def test_band_widens_with_the_root_of_the_step(spark):
    rows = make_series(spark, a=[10, 12, 9, 14, 10, 15, 11, 13])
    fit = linear.fit_line(rows, K)
    sigma = fit.first().sigma
    ahead = by(linear.forecast_trend(fit, K, 4), "step")
    assert ahead[4].upper_ci - ahead[4].forecast == pytest.approx(1.96 * sigma * 2)


def test_accuracy_ignores_pairs_of_zeros(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 5.0), ("a", 10.0, 5.0), ("z", 0.0, 0.0)], "name string, actual double, predicted double")
    scores = by(evaluate.evaluate_forecast(df, K), "name")
    assert scores["a"].smape == pytest.approx((200 + 200 * 5 / 15) / 2) and scores["a"].mae == pytest.approx(10 / 3)
    assert scores["z"].smape == 0 and scores["z"].n_test_periods == 1
    more = by(evaluate.forecast_accuracy(df, K), "name")
    assert more["a"].mape == pytest.approx(50) and more["z"].mape is None and more["z"].r2 == 1


def test_scenarios(spark):
    rows = make_series(spark, a=[10, 20, 30, 50])
    got = by(scenario.scenario_forecasts(rows, K, 2), "scenario", "step")
    assert got["Expected", 2].forecast == pytest.approx(50 + 10 * 2)
    assert got["Optimistic", 2].forecast == pytest.approx(50 + 12 * 2)
    assert got["Conservative", 2].forecast == pytest.approx(0.9 * 70)
    falling = by(scenario.scenario_forecasts(make_series(spark, a=[50, 10]), K, 3), "scenario", "step")
    assert falling["Expected", 3].forecast == 0


def test_holt_on_an_exact_line_has_small_errors():
    y = np.array([5.0 + 3 * i for i in range(30)])
    _, (level, trend), errors = fits.fit_holt(y)
    assert np.abs(errors).max() < 0.2 and level == pytest.approx(y[-1], rel=1e-2)


def test_starting_states_are_the_best_for_their_weights():
    y = seasonal(60)
    p = np.array([[0.3, 0.1, 0.9], [0.8, 0.0, 0.98]])
    starts, cost = fits.best_starts(fits.holt, y, p, np.eye(2))
    sse = lambda s: (fits.holt(y, p, s)[1] ** 2).sum(axis=0)
    assert sse(starts) == pytest.approx(cost)
    for step in ([1e-2, 0], [0, 1e-2], [-1e-2, 1e-2]):
        assert (sse(starts + step) >= cost - 1e-9).all() and (sse(starts - np.array(step)) >= cost - 1e-9).all()
    run = lambda y, p, s: fits.winters(y, p, s, 12)
    basis = fits.winters_basis(12)
    starts, cost = fits.best_starts(run, y, p[:, [0, 1, 1]], basis)
    assert np.abs(starts[:, 2:].sum(1)).max() < 1e-6
    for direction in basis.T:
        assert ((run(y, p[:, [0, 1, 1]], starts + 0.05 * direction)[1] ** 2).sum(axis=0) >= cost - 1e-6).all()


def grid_search(cost_of, grid, reach):
    """A search over weights alone, from starting states of the data: the best of a grid and of finer ones around it."""
    reach = np.array(reach)
    points = np.array(list(itertools.product(*grid)))
    steps = np.array(list(itertools.product((-1.0, 0.0, 1.0), repeat=3)))
    for zoom in (1.0, 0.5, 0.25, 0.12, 0.06):
        best = points[int(np.argmin(cost_of(points)))]
        points = np.clip(best + steps * reach[:, 0] * zoom, reach[:, 1], reach[:, 2])
    return cost_of(points).min()


@pytest.mark.parametrize("seed", range(4))
def test_fitting_states_too_is_never_worse(seed):
    y = seasonal(60, seed) + 5 * np.random.default_rng(seed).normal(size=60).cumsum()

    def holt_cost(p):
        starts = np.array([fits.holt_start(y, phi) for phi in p[:, 2]])
        return (fits.holt(y, p, starts)[1] ** 2).sum(axis=0)

    def winters_cost(p):
        return (fits.winters(y, p, np.tile(fits.winters_start(y, 12), (len(p), 1)), 12)[1] ** 2).sum(axis=0)

    assert (fits.fit_holt(y)[2] ** 2).sum() <= grid_search(holt_cost, fits.HOLT_GRID, fits.HOLT_REACH) + 1e-6
    assert (fits.fit_winters(y, 12)[2] ** 2).sum() <= grid_search(winters_cost, fits.WINTERS_GRID, fits.WINTERS_REACH) + 1e-6


def test_structural_fit_is_the_most_likely():
    rng = np.random.default_rng(2)
    x = np.linspace(0, 1, 48)
    plain, sparse = np.column_stack([np.ones(48), x]), parts.hinges(x, np.linspace(0.1, 0.8, 8))
    y = 0.3 + 0.2 * x + 0.8 * np.maximum(x - 0.4, 0) + 0.02 * rng.normal(size=48)
    prior, laplace, noise = np.array([5.0, 5.0]), 0.05, 0.05

    def cost(b, d):
        return ((y - plain @ b - sparse @ d) ** 2).sum() / (2 * noise**2) + ((b / prior) ** 2).sum() / 2 + np.abs(d).sum() / laplace

    b, d = parts.sparse_fit(y, plain, prior, sparse, laplace, noise)
    assert 0 < (d == 0).sum() < 8
    for _ in range(300):
        size = 10.0 ** -rng.integers(1, 5)
        assert cost(b + size * rng.normal(size=2), d + size * rng.normal(size=8) * (rng.random(8) < 0.5)) >= cost(b, d) - 1e-9
    # Where a coefficient is 0 its slope is within the prior's, elsewhere it is the prior's.
    slope = sparse.T @ (y - plain @ b - sparse @ d) / noise**2
    assert np.abs(slope[d == 0]).max() <= 1 / laplace + 1e-4
    assert slope[d != 0] == pytest.approx(np.sign(d[d != 0]) / laplace, abs=1e-3)


def test_a_planted_change_of_trend_is_found():
    t = np.arange(60)
    model = parts.fit(100 + t + 6.0 * np.maximum(t - 30, 0) + np.random.default_rng(1).normal(size=60), 12)
    where = model.knots[np.abs(model.changes) > 0.3 * np.abs(model.changes).max()] * 59
    assert len(where) <= 3 and np.abs(where - 30).min() < 3
    assert (model.changes == 0).sum() >= 15
    low, high = model.interval(12)
    assert (np.diff(high - low) > -5).all() and (high > low).all()
    assert (model.interval(12)[0] == low).all()


def test_multiplicative_season():
    t = np.arange(72)
    wave = 1 + 0.3 * np.sin(2 * np.pi * t / 12)
    y = (100 + 5 * t) * wave
    share, plain = (parts.fit(y[:60], 12, multiplicative=m) for m in (True, False))
    ahead = np.arange(60, 72)
    assert np.abs(share.predict(ahead) / y[60:] - 1).max() < 0.05
    assert np.abs(share.predict(ahead) - y[60:]).max() < 0.5 * np.abs(plain.predict(ahead) - y[60:]).max()


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        structural.fit_structural(make_series(spark, a=[1, 2]), K, mode="loud")


def test_winters_follows_the_season(spark):
    y = seasonal(72, noise=0.5)
    rows = make_series(spark, a=y[:60], short=y[:20])
    fit = smoothing.fit_winters(smoothing.as_arrays(rows, K))
    ahead = by(smoothing.forecast_winters(fit, K, 12), "name", "step")
    assert {n for n, _ in ahead} == {"a"}
    error = max(abs(ahead["a", i + 1].forecast - y[60 + i]) for i in range(12))
    assert error < 8
    assert all(r.lower_ci <= r.forecast <= r.upper_ci for r in ahead.values())


def test_trend_pipeline_picks_the_line_on_a_line(spark):
    rows = make_series(spark, line=[5 + 2 * i for i in range(20)], four=[1, 2, 3, 4], five=[1, 2, 3, 4, 5])
    out = select.trend_pipeline(rows, K, periods=3)
    scores = by(out["evaluation"], "name")
    assert scores["line"].model == "Linear Trend" and scores["line"].smape == pytest.approx(0, abs=1e-6)
    assert scores["line"].sarima_ready and not scores["five"].sarima_ready
    assert scores["four"].status == "too short" and scores["four"].model is None and scores["five"].status == "ok"
    ahead = by(out["forecast"], "name", "step")
    assert ahead["line", 1].forecast == pytest.approx(45) and ("four", 1) not in ahead
    assert out["predictions"].where("name = 'five'").count() == 2
    assert out["scenarios"].where("name = 'line'").count() == 9


def test_levels_in_one_pass(spark):
    panel = spark.createDataFrame([(day("2023-01-05"), "A", 1.0), (day("2023-01-01"), "B", 2.0)], "date date, state string, m double")
    rows = by(select.metric_series(panel, ["m"]), "level", "state")
    assert rows["National", "All"].value == 3 and rows["State", "B"].value == 2
    assert by(select.metric_series(panel, ["m"], how="mean"), "state")["All"].value == 1.5
    assert select.metric_series(panel.drop("state"), ["m"], by_state=False).first().value == 3


def test_arima_recovers_coefficients():
    rng = np.random.default_rng(3)
    e = rng.normal(size=2000)
    y = np.zeros(2000)
    for t in range(1, 2000):
        y[t] = 0.6 * y[t - 1] + e[t] + 0.3 * e[t - 1]
    model = arima_fit.fit(y + 50, (1, 0, 1))
    ar, ma, mean = model.params
    assert (ar, ma, mean) == (pytest.approx(0.6, abs=0.07), pytest.approx(0.3, abs=0.07), pytest.approx(50, abs=0.3))
    point, spread = arima_fit.forecast(y + 50, model, 200)
    assert point[-1] == pytest.approx(mean, abs=0.1) and spread[0] == pytest.approx(1, abs=0.1)
    assert np.all(np.diff(spread) >= -1e-12)


def autocovariances(phi, theta, n, terms=4000):
    """Of an ARMA process with noise of variance 1, from so many terms of its moving average."""
    psi = np.zeros(terms)
    for j in range(terms):
        psi[j] = (theta[j] if j < len(theta) else 0.0) - sum(phi[i] * psi[j - i] for i in range(1, min(j, len(phi) - 1) + 1))
    return np.array([psi[: terms - k] @ psi[k:] for k in range(n)])


def dense_loglik(y, model):
    """Density of all differences as one Gaussian vector."""
    phi, theta, mean = model.polynomials()
    w = np.convolve(y, arima_fit.difference_polynomial(model.order[1], model.seasonal[1], model.seasonal[3]), mode="valid") - mean
    g = autocovariances(phi, theta, len(w)) * model.sigma2
    cov = g[np.abs(np.subtract.outer(np.arange(len(w)), np.arange(len(w))))]
    return -0.5 * (len(w) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + w @ np.linalg.solve(cov, w))


def simulated(seed, n=70):
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n), np.zeros(n)
    for t in range(2, n):
        y[t] = 0.5 * y[t - 1] - 0.2 * y[t - 2] + e[t] + 0.4 * e[t - 1]
    return y + 3 * np.sin(np.arange(n) * np.pi / 6)


ORDERS = [
    ((1, 0, 0), (0, 0, 0, 0)), ((0, 0, 1), (0, 0, 0, 0)), ((2, 0, 1), (0, 0, 0, 0)), ((1, 1, 1), (0, 0, 0, 0)), ((0, 1, 0), (0, 0, 0, 0)),
    ((3, 2, 2), (0, 0, 0, 0)), ((1, 0, 1), (1, 0, 0, 12)), ((0, 1, 1), (0, 1, 1, 12)), ((1, 1, 1), (1, 1, 1, 12)), ((1, 0, 0), (0, 0, 1, 4)),
]


def test_likelihood_is_that_of_one_gaussian_vector():
    ys = [np.cumsum(simulated(i)) if o[1] else simulated(i) for i, (o, _) in enumerate(ORDERS)]
    # Fitted together, with rows of other lengths and orders, as each alone.
    together = arima_fit.fit_many(ys, [o for o, _ in ORDERS], [s for _, s in ORDERS])
    for y, (order, seasonal), model in zip(ys, ORDERS, together):
        assert model.loglik == pytest.approx(dense_loglik(y, model), abs=1e-4), (order, seasonal)
        assert arima_fit.fit(y, order, seasonal).loglik == pytest.approx(model.loglik, abs=1e-3)
        assert model.aic == pytest.approx(2 * (arima_fit.n_params(order, seasonal) + 1) - 2 * model.loglik)


def test_no_parameters_nearby_are_likelier():
    from dataclasses import replace

    for i, (order, seasonal) in enumerate(ORDERS):
        y = simulated(i + 20)
        model = arima_fit.fit(y, order, seasonal)
        for j in range(len(model.params)):
            for step in (-0.02, 0.02):
                params = model.params.copy()
                params[j] += step
                other = replace(model, params=params)
                phi, theta, _ = other.polynomials()
                if max(np.abs(np.roots(phi)).max(initial=0), np.abs(np.roots(theta)).max(initial=0)) < 0.995:
                    assert dense_loglik(y, other) <= model.loglik + 1e-3, (order, seasonal, j)


def test_likelihood_in_closed_form():
    y = simulated(3)
    walk = arima_fit.fit(y, (0, 1, 0))
    s2 = np.mean(np.diff(y) ** 2)
    assert walk.sigma2 == pytest.approx(s2) and walk.loglik == pytest.approx(-0.5 * 69 * (np.log(2 * np.pi * s2) + 1))
    ar = arima_fit.fit(y, (1, 0, 0))
    phi, mean = ar.params
    z = y - mean
    squares = z[0] ** 2 * (1 - phi**2) + ((z[1:] - phi * z[:-1]) ** 2).sum()
    want = -0.5 * (70 * np.log(2 * np.pi * ar.sigma2) + squares / ar.sigma2 - np.log(1 - phi**2))
    assert ar.loglik == pytest.approx(want)


def test_aic_speaks_of_the_same_points():
    y = np.cumsum(simulated(5))
    with_skip = arima_fit.fit_many([y, y, y], [(0, 0, 0), (0, 1, 0), (0, 2, 0)], [(0, 0, 0, 0)] * 3, [2, 1, 0])
    assert [m.n_used for m in with_skip] == [68, 68, 68]
    left = arima_fit.fit_many([y], [(1, 1, 0)], [(0, 0, 0, 0)], [4])[0]
    phi, _, _ = left.polynomials()
    w = np.diff(y)
    errors = w[4:] + phi[1] * w[3:-1]
    assert left.loglik == pytest.approx(-0.5 * 65 * (np.log(2 * np.pi * np.mean(errors**2)) + 1), abs=1e-6)


def test_fitted_values_and_forecasts_are_conditional_means():
    y = simulated(8, 40)
    model = arima_fit.fit(y, (2, 0, 1))
    phi, theta, mean = model.polynomials()
    g = autocovariances(phi, theta, 46)
    cov = g[np.abs(np.subtract.outer(np.arange(46), np.arange(46)))]
    fitted = arima_fit.fitted_values(y, model)
    for t in (0, 1, 5, 39):
        want = mean + (cov[t, :t] @ np.linalg.solve(cov[:t, :t], y[:t] - mean) if t else 0.0)
        assert fitted[t] == pytest.approx(want, abs=1e-6)
    want = mean + cov[40:, :40] @ np.linalg.solve(cov[:40, :40], y - mean)
    assert arima_fit.forecast(y, model, 6)[0] == pytest.approx(want, abs=1e-6)
    walk = arima_fit.fitted_values(y, arima_fit.fit(y, (0, 1, 0)))
    assert np.isnan(walk[0]) and walk[1:] == pytest.approx(y[:-1])


def test_arima_differencing_continues_a_line():
    y = np.array([3.0 + 2 * i for i in range(30)])
    model = arima_fit.fit(y, (0, 2, 0))
    assert arima_fit.forecast(y, model, 3)[0] == pytest.approx([63, 65, 67])
    walk = arima_fit.fit(y, (0, 1, 0))
    assert arima_fit.forecast(y, walk, 2)[0] == pytest.approx([61, 61])
    assert arima_fit.fit(y[:4], (2, 1, 2)) is None


def test_sarima_beats_arima_on_a_season(spark):
    rows = make_series(spark, a=seasonal(84, 1), short=[1, 2, 3, 4, 5, 6, 7, 8])
    plain = by(arima.fit_arima(rows, K), "name")
    season = by(arima.sarima_pipeline(rows, K), "name")
    assert season["a"].mae < plain["a"].mae and season["a"].status == "ok"
    assert season["short"].status == "too short" and season["short"].failed
    assert all(lo <= f <= up for lo, f, up in zip(season["a"].lower, season["a"].forecast, season["a"].upper))
    ahead = arima.arima_forecast(arima.sarima_pipeline(rows, K), rows, K, 12, "sarima")
    assert {(r["name"], r.method) for r in ahead.collect()} == {("a", "sarima"), ("short", "linear")}


def test_order_search_is_no_worse_than_the_default(spark):
    rows = make_series(spark, a=seasonal(60, 2), tiny=[1.0, 2.0, 3.0])
    search = arima.order_search(rows, K, 2, 1, 2)
    assert search.count() == 2 * 3 * 2 * 3
    aics = {(r.p, r.d, r.q): r.aic for r in search.where("name = 'a'").collect()}
    best = by(arima.best_order(search, K), "name")
    assert best["a"].aic <= aics[1, 1, 1] and aics[tuple(best["a"].order)] == best["a"].aic
    assert best["tiny"].order is not None
    fitted = arima.fit_best_arima(rows.where("name = 'a'"), K, 6, max_p=1, max_d=1, max_q=1).first()
    assert len(fitted.forecast) == 6


def test_stationarity(spark):
    rng = np.random.default_rng(5)
    noise = rng.normal(size=120)
    rows = make_series(spark, noise=noise, walk=np.cumsum(rng.normal(size=120)), short=noise[:9], flat=[1.0] * 30)
    got = by(arima.check_stationarity(rows, K), "name")
    assert got["noise"].is_stationary and got["noise"].p_value < 0.01
    assert not got["walk"].is_stationary and got["walk"].p_value > 0.05
    assert got["short"].message == "Insufficient data for ADF test" and got["short"].p_value is None
    assert not got["flat"].is_stationary


def test_structural_follows_trend_and_season(spark):
    y = seasonal(72, 4, 0.5)
    rows = make_series(spark, a=y[:60], short=[1, 2, 3])
    fit = structural.fit_structural(rows, K, 12)
    ahead = by(structural.forecast_structural(fit, K, 12), "name", "step")
    assert max(abs(ahead["a", i + 1].forecast - y[60 + i]) for i in range(12)) < 10
    assert ahead["a", 1].date == day("2025-01-31") and ("short", 12) in ahead
    assert all(r.lower_ci <= r.forecast <= r.upper_ci for r in ahead.values())


def test_ensemble_and_choice(spark):
    rows = make_series(spark, a=seasonal(60, 6), b=10 * seasonal(60, 7), tiny=[4.0, 5.0])
    scores, ahead = ensemble.fit_ensemble(rows, K, 4, trees=5, rounds=5)
    got = by(ahead, "name", "step")
    assert set(got) == {(n, s) for n in "ab" for s in range(1, 5)}
    assert all(r.r2 > 0.5 for r in scores.collect())
    assert got["b", 1].forecast > 3 * got["a", 1].forecast
    best = by(select.enhanced_forecasts(rows, K, 3, trees=5, rounds=5), "name", "step")
    assert {n for n, _ in best} == {"a", "b", "tiny"}
    with pytest.raises(ValueError):
        select.enhanced_models(rows, K, 3, ["oracle"])


def test_unknown_method(spark):
    df = spark.createDataFrame([(day("2023-01-01"), 1.0)], "date date, v double")
    with pytest.raises(ValueError):
        select.generate_forecasts(df, "v", method="guess")


def test_decomposition_recovers_parts(spark):
    t = np.arange(48)
    wave = 10 * np.sin(2 * np.pi * t / 12)
    rows = decompose(make_series(spark, a=50 + 2 * t + wave), K).orderBy("date").collect()
    inner = rows[6:-6]
    assert rows[0].trend is None and rows[-1].trend is None and rows[0].seasonal is not None
    assert [r.trend for r in inner] == pytest.approx([50 + 2 * i for i in range(6, 42)])
    assert [r.seasonal for r in rows] == pytest.approx(list(wave), abs=1e-6)
    assert max(abs(r.residual) for r in inner) < 1e-6
    scaled = decompose(make_series(spark, a=(50 + 2 * t) * (1 + wave / 100)), K, "multiplicative").where("trend IS NOT NULL").collect()
    assert max(abs(r.residual - 1) for r in scaled) < 0.01
    odd = decompose(make_series(spark, a=t % 7), K, period=7).where("trend IS NOT NULL").collect()
    assert {round(r.trend, 9) for r in odd} == {3.0}
    with pytest.raises(ValueError):
        decompose(make_series(spark, a=t), K, "cubic")


def test_lag_features(spark):
    rows = ensemble.lag_features(make_series(spark, a=[1, 2, 4, 8, 16]), K).orderBy("date").collect()
    assert [(r.value, r.lag_1, r.lag_3, r.rolling_mean_3) for r in rows] == [(8, 4, 1, pytest.approx(7 / 3)), (16, 8, 2, pytest.approx(14 / 3))]
    current = ensemble.lag_features(make_series(spark, a=[1, 2, 4, 8]), K, include_current=True).collect()
    assert [r.rolling_mean_3 for r in current] == [pytest.approx(14 / 3)]
    assert months("2020-11", 3)[2] == day("2021-01-01")


@pytest.mark.parametrize("seasonal", [(0, 0, 0, 0), (1, 1, 1, 12)])
def test_short_series_do_not_end_the_job(spark, seasonal):
    import math

    values = {f"n{n}": [float(i % 3) for i in range(n)] for n in range(1, 13)}
    values |= {"constant": [5.0] * 30, "whole": [10 + i + 3 * math.sin(i) for i in range(48)]}
    rows = by(arima.fit_arima(make_series(spark, **values), ["name"], (1, 1, 1), seasonal), "name")
    assert len(rows) == len(values) and not rows["whole"].failed
    assert rows["n1"].failed and rows["n2"].failed
    assert rows["n8"].mae is not None


def test_orders_of_series_too_short(spark):
    series = make_series(spark, one=[1.0], two=[1.0, 2.0])
    best = by(arima.best_order(arima.order_search(series, ["name"]), ["name"]), "name")
    assert [list(best[n].order) for n in ("one", "two")] == [[1, 1, 1], [1, 1, 1]]
