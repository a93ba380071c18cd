"""Trend metrics: statistics and forecasts over the history of another metric."""

from __future__ import annotations

import math
from datetime import datetime
from typing import Any

import numpy as np

DESCRIPTIVE = {
    "avg": lambda x, q: float(np.mean(x)), "std": lambda x, q: float(np.std(x, ddof=1)) if len(x) > 1 else 0.0, "min": lambda x, q: float(np.min(x)),
    "max": lambda x, q: float(np.max(x)), "sum": lambda x, q: float(np.sum(x)), "median": lambda x, q: float(np.quantile(x, 0.5)),
    "firstQuartile": lambda x, q: float(np.quantile(x, 0.25)), "thirdQuartile": lambda x, q: float(np.quantile(x, 0.75)),
    "quantile": lambda x, q: float(np.quantile(x, q)),
}
KINDS = (*DESCRIPTIVE, "linearRegression", "arima")
ALIASES = {"linreg": "linearRegression"}


def evaluate(kind: str, spec: dict[str, Any], past: list[tuple[datetime, float]], reference: datetime) -> tuple[float, str | None]:
    """(result, further information) of a trend metric over (date, value) pairs; NaN values are dropped; no value raises."""
    kind = ALIASES.get(kind, kind)
    past = sorted((d, v) for d, v in past if not math.isnan(v))
    if not past:
        raise ValueError("no history")
    values = np.array([v for _, v in past])
    if kind in DESCRIPTIVE:
        return DESCRIPTIVE[kind](values, float(spec.get("quantile", 0.5))), None
    if kind == "linearRegression":
        return linear(past, reference)
    if kind == "arima":
        return arima(values, *[int(x) for x in spec["order"]])
    raise ValueError(f"no trend metric {kind!r}")


def linear(past: list[tuple[datetime, float]], reference: datetime) -> tuple[float, str]:
    """Least-squares line through the history, read off at the reference date."""
    if len(past) < 2:
        raise ValueError("a line needs two results or more")
    t = np.array([d.timestamp() * 1000 for d, _ in past])
    v = np.array([x for _, x in past])
    middle = t.mean()
    spread = ((t - middle) ** 2).sum()
    slope = ((t - middle) * (v - v.mean())).sum() / spread if spread else math.nan
    predicted = v.mean() + slope * (reference.timestamp() * 1000 - middle)
    residual = v - v.mean() - slope * (t - middle)
    mse = float((residual ** 2).sum() / (len(v) - 2)) if len(v) > 2 else math.nan
    return float(predicted), f'{{"n":{len(v)},"mse":{mse}}}'


def arima(values: np.ndarray, p: int, d: int, q: int) -> tuple[float, str]:
    """One-step forecast of an ARIMA(p, d, q) model with intercept.

    Without a moving-average part the model is fitted by least squares;
    otherwise the start is Hannan and Rissanen's two-step regression, refined
    by gradient descent with line search on the conditional sum of squares.
    """
    if p < 0 or d < 0 or q < 0 or p + q == 0:
        raise ValueError("the order must be non-negative, with p + q > 0")
    need = 2 * (max(p, q) + 3) + d + 2
    if len(values) < need:
        raise ValueError(f"ARIMA({p},{d},{q}) needs {need} results, not {len(values)}")
    x = np.diff(values, d) if d else values.astype(float)

    def lags(series: np.ndarray, k: int, start: int) -> np.ndarray:
        return np.stack([series[start - i:len(series) - i] for i in range(1, k + 1)], 1) if k else np.zeros((len(series) - start, 0))

    def regress(a: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(np.hstack([np.ones((len(a), 1)), a]), y, rcond=None)[0]

    def residuals(theta: np.ndarray) -> np.ndarray:
        c, ar, ma = theta[0], theta[1:p + 1], theta[p + 1:]
        e = np.zeros(len(x))
        for t in range(max(p, q), len(x)):
            e[t] = x[t] - c - (ar @ x[t - p:t][::-1] if p else 0) - (ma @ e[t - q:t][::-1] if q else 0)
        return e

    if q == 0:
        theta = regress(lags(x, p, p), x[p:])
    else:
        m = max(p, q) + 1
        wide = regress(lags(x, m, m), x[m:])
        e = np.r_[np.zeros(m), x[m:] - wide[0] - lags(x, m, m) @ wide[1:]]
        k = m + max(p, q)
        theta = regress(np.hstack([lags(x, p, k), lags(e, q, k)]), x[k:])
        loss = lambda th: float((residuals(th)[max(p, q):] ** 2).sum())
        best = loss(theta)
        for _ in range(200):
            h = 1e-6 * (1 + np.abs(theta))
            grad = np.array([(loss(theta + h * (np.arange(len(theta)) == i)) - loss(theta - h * (np.arange(len(theta)) == i))) / (2 * h[i]) for i in range(len(theta))])
            step, norm = 1.0, float(grad @ grad)
            if not np.isfinite(norm) or norm < 1e-18:
                break
            while step > 1e-14:
                new = theta - step * grad / math.sqrt(norm)
                got = loss(new)
                if np.isfinite(got) and got < best - 1e-12 * abs(best) and np.abs(new[p + 1:]).sum() < 1:
                    break
                step /= 2
            else:
                break
            gain, theta, best = best - got, new, got
            if gain < 1e-10 * (1 + abs(best)):
                break
    e = residuals(theta)
    forecast = theta[0] + (theta[1:p + 1] @ x[len(x) - p:][::-1] if p else 0) + (theta[p + 1:] @ e[len(e) - q:][::-1] if q else 0)
    level, series = float(forecast), values.astype(float)
    for k in range(d):  # undo the differences from the last level up
        level += float(np.diff(series, d - 1 - k)[-1])
    mse = float((e[max(p, q):] ** 2).mean())
    return level, f'{{"n":{len(values)},"mse":{mse}}}'
