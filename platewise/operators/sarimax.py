"""Seasonal ARIMA with regressors by exact likelihood, many series at a time.

The differenced series is a linear state-space model whose Kalman filter gives the exact
Gaussian likelihood. Regressor weights and the variance are solved for within the filter
(the same gains run over the regressors), so only the four coefficients are searched for,
by compass steps on a scale that keeps the model stationary and invertible: first by
conditional sums of squares, which need no covariances, then by the exact likelihood. All
series of a batch are filtered together, a few vector operations per day: started from
the stationary state, the covariance changes by one rank a day, so only that is updated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Coefficients stay within this bound, so the stationary state is well defined.
BOUND = 0.98
# Sums of powers double their terms each time; BOUND ** 2 ** DOUBLINGS is nothing.
DOUBLINGS = 12
START = 0.3
# First step, last step and most moves of the search by sums of squares, and of the one by likelihood that ends it.
COARSE, FINE = (0.8, 0.01, 60), (0.05, 0.02, 6)
# Bound of the search's scale, on which a coefficient is BOUND * tanh.
WIDEST = 2.5


@dataclass(frozen=True)
class Orders:
    """(p, d, q) and (P, D, Q) with the season; every order is 0 or 1."""

    p: int = 1
    d: int = 1
    q: int = 1
    seasonal_p: int = 1
    seasonal_d: int = 1
    seasonal_q: int = 1
    season: int = 7

    @property
    def states(self) -> int:
        return max(self.p + self.season * self.seasonal_p, self.q + self.season * self.seasonal_q + 1, 1)

    @property
    def differences(self) -> np.ndarray:
        """The polynomial that differences a series: its value at t is the sum of coefficient k times the value at t - k."""
        out = np.ones(1)
        if self.d:
            out = np.convolve(out, [1.0, -1.0])
        if self.seasonal_d:
            out = np.convolve(out, [1.0, *[0.0] * (self.season - 1), -1.0])
        return out

    @property
    def used(self) -> np.ndarray:
        """Which of (ar, ma, seasonal ar, seasonal ma) are searched for."""
        return np.array([self.p, self.q, self.seasonal_p, self.seasonal_q], bool)


ORDERS = Orders()


def differenced(columns: np.ndarray, orders: Orders) -> np.ndarray:
    """Rows of days (days × columns) differenced; the first days are used up."""
    lost = len(orders.differences) - 1
    return sum(c * columns[lost - k : len(columns) - k] for k, c in enumerate(orders.differences))


def _expanded(coefficients: np.ndarray, orders: Orders) -> tuple[np.ndarray, np.ndarray]:
    """Weights of past values, and of past shocks from lag 0, of batches of (ar, ma, seasonal ar, seasonal ma)."""
    ar, ma, seasonal_ar, seasonal_ma = (coefficients * orders.used).T
    r, s = orders.states, orders.season
    values, shocks = np.zeros((len(coefficients), r + 1)), np.zeros((len(coefficients), r + 1))
    shocks[:, 0] = 1.0
    for lag, value, shock in ((1, ar, ma), (s, seasonal_ar, seasonal_ma), (s + 1, -ar * seasonal_ar, ma * seasonal_ma)):
        if lag <= r:
            values[:, lag] += value
            shocks[:, lag] += shock
    return values[:, 1:], shocks[:, :r]


def _stationary(transition: np.ndarray, shocks: np.ndarray) -> np.ndarray:
    """Covariance of the state that the model keeps."""
    covariance, power = shocks[:, :, None] * shocks[:, None, :], transition
    for _ in range(DOUBLINGS):
        covariance = covariance + power @ covariance @ power.transpose(0, 2, 1)
        power = power @ power
    return covariance


def _moved(vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A day's transition of batches of vectors: weights in the first column and ones above the diagonal."""
    out = vectors[:, :1] * values
    out[:, :-1] += vectors[:, 1:]
    return out


@dataclass
class Filtered:
    loglikelihood: np.ndarray  # of each batch entry
    variance: np.ndarray
    weights: np.ndarray  # of the regressors
    state: np.ndarray  # after the last day, per column


def filtered(data: np.ndarray, days: np.ndarray, coefficients: np.ndarray, orders: Orders = ORDERS) -> Filtered:
    """Kalman filter of batches: `data` (batch × days × columns, the series first), of which entry i has `days[i]` days."""
    values, shocks = _expanded(coefficients, orders)
    n, r, columns = len(data), orders.states, data.shape[2]
    transition = np.zeros((n, r, r))
    transition[:, :, 0] = values
    transition[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    covariance, state = _stationary(transition, shocks), np.zeros((n, columns, r))
    products, log_variances = np.zeros((n, columns, columns)), np.zeros(n)
    last, ends = np.zeros((n, columns, r)), set(days.tolist())
    spread = covariance[:, 0, 0].copy()
    through = _moved(covariance[:, :, 0], values)  # gain times spread
    change, factor = through.copy(), -1.0 / spread  # the covariance changes by factor * change * change'
    for t in range(data.shape[1]):
        here = t < days
        error = data[:, t] - state[:, :, 0]
        gain = through / spread[:, None]
        products += (here / spread)[:, None, None] * error[:, :, None] * error[:, None, :]
        log_variances += here * np.log(spread)
        ahead = state[:, :, :1] * values[:, None, :] + error[:, :, None] * gain[:, None, :]
        ahead[:, :, :-1] += state[:, :, 1:]
        state = ahead
        if t + 1 in ends:
            ended = days == t + 1
            last[ended] = state[ended]
        top = change[:, 0].copy()
        forward = _moved(change, values)
        wider = spread + factor * top * top
        through = through + (factor * top)[:, None] * forward
        factor, spread = factor * wider / spread, wider
        change = forward - through * (top / spread)[:, None]
    weights, rest = _least_squares(products)
    variance = np.maximum(rest / days, 1e-12)
    likelihood = -0.5 * (days * (np.log(2 * np.pi * variance) + 1) + log_variances)
    return Filtered(likelihood, variance, weights, last)


def _least_squares(products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the later columns in the first, and the squares left, from the columns' products."""
    inner, cross = products[:, 1:, 1:], products[:, 1:, 0]
    if not inner.shape[1]:
        return np.zeros((len(products), 0)), products[:, 0, 0]
    weights = (np.linalg.pinv(inner, hermitian=True) @ cross[:, :, None])[:, :, 0]
    return weights, products[:, 0, 0] - (weights * cross).sum(axis=1)


def conditional(data: np.ndarray, days: np.ndarray, coefficients: np.ndarray, orders: Orders = ORDERS) -> np.ndarray:
    """Log-likelihood of batches from shocks that are 0 before the first day, up to a constant."""
    ar, ma, seasonal_ar, seasonal_ma = (coefficients * orders.used).T[:, None, :, None]
    s, x = orders.season, np.ascontiguousarray(data.transpose(1, 0, 2))  # days first
    for lag, weight in ((1, ar), (s, seasonal_ar)):
        later = x.copy()
        later[lag:] -= weight * x[:-lag]
        x = later
    if orders.seasonal_q:
        for t in range(s, len(x), s):
            x[t : t + s] -= seasonal_ma * x[t - s : t - s + len(x[t : t + s])]
    if orders.q:
        for t in range(1, len(x)):
            x[t] -= ma[0] * x[t - 1]
    x *= (np.arange(len(x))[:, None] < days)[:, :, None]
    if x.shape[2] == 1:
        rest = np.einsum("tnc,tnc->n", x, x)
    else:
        rest = _least_squares(np.einsum("tnc,tnd->ncd", x, x))[1]
    return -0.5 * days * np.log(np.maximum(rest / days, 1e-12))


def fitted(data: np.ndarray, days: np.ndarray, orders: Orders = ORDERS) -> np.ndarray:
    """The coefficients (ar, ma, seasonal ar, seasonal ma) of each entry with the largest likelihood found.

    From one starting point each entry moves to the best of its neighbours a step away
    along an axis, and halves its step where none is better.
    """
    n, axes = len(data), np.flatnonzero(orders.used)
    at = np.zeros((n, 4))
    at[:, axes] = START * np.array([1, -1, 1, -1])[axes]
    offsets = np.zeros((2 * len(axes), 4))
    for i, axis in enumerate(axes):
        offsets[2 * i : 2 * i + 2, axis] = (1, -1)

    def exact(points: np.ndarray, of: np.ndarray) -> np.ndarray:
        return filtered(data[of], days[of], BOUND * np.tanh(points), orders).loglikelihood

    def coarse(points: np.ndarray, of: np.ndarray) -> np.ndarray:
        return conditional(data[of], days[of], BOUND * np.tanh(points), orders)

    for value, (first, final, moves) in ((coarse, COARSE), (exact, FINE)) if len(axes) else ():
        best, step = value(at, np.arange(n)), np.full(n, first)
        for _ in range(moves):
            live = np.flatnonzero(step > final)
            if not len(live):
                break
            near = np.clip(at[live, None] + step[live, None, None] * offsets, -WIDEST, WIDEST)
            found = value(near.reshape(-1, 4), np.repeat(live, len(offsets))).reshape(len(live), -1)
            pick = found.argmax(axis=1)
            better = found[np.arange(len(live)), pick] > best[live] + 1e-9
            moved = live[better]
            at[moved], best[moved] = near[better, pick[better]], found[better, pick[better]]
            step[live[~better]] /= 2
    return BOUND * np.tanh(at)


def forecasts(
    series: list[np.ndarray], past: list[np.ndarray], future: list[np.ndarray], horizon: int, orders: Orders = ORDERS
) -> list[np.ndarray]:
    """The next `horizon` values of each series, with its regressors (days × columns) so far and to come.

    A regressor that differencing removes has no weight.
    """
    lags = orders.differences
    moved = [differenced(np.column_stack([y, x]), orders) for y, x in zip(series, past, strict=True)]
    days = np.array(list(map(len, moved)))
    data = np.zeros((len(moved), days.max(), moved[0].shape[1]))
    for i, rows in enumerate(moved):
        data[i, : len(rows)] = rows
    left = np.flatnonzero(np.abs(data[:, :, 1:]).max(axis=(0, 1), initial=0.0) > 1e-9)
    data = data[:, :, [0, *(left + 1)]]
    coefficients = fitted(data, days, orders)
    done, values = filtered(data, days, coefficients, orders), _expanded(coefficients, orders)[0]
    state = done.state[:, 0] - np.einsum("nc,ncr->nr", done.weights, done.state[:, 1:])
    ahead = np.zeros((len(moved), horizon))
    for h in range(horizon):
        ahead[:, h] = state[:, 0]
        state = state[:, :1] * values + np.pad(state[:, 1:], ((0, 0), (0, 1)))
    out = []
    for i, (y, x, later) in enumerate(zip(series, past, future, strict=True)):
        known = list(y)
        effect = differenced(np.vstack([x, later]), orders)[-horizon:, left] @ done.weights[i]
        for h in range(horizon):
            known.append(ahead[i, h] + effect[h] - sum(c * known[-k] for k, c in enumerate(lags) if k))
        out.append(np.array(known[len(y) :]))
    return out
