"""Curves fitted to series and tests by permutation. One series is one group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MODELS = {
    "exponential": lambda x, a, b, k: a + b * (1 - np.exp(-k * x)),
    "logistic": lambda x, a, b, k: a + b * (1 / (1 + np.exp(-k * (x - x.mean())))),
    "gompertz": lambda x, a, b, k: a + b * np.exp(-np.exp(-k * (x - x.mean()))),
    "plateau": lambda x, a, b, k: a + b * np.minimum(x, k),
}


def _shape(name: str, x: np.ndarray, k: float) -> np.ndarray:
    return MODELS[name](x, 0.0, 1.0, k)


def fit_shape(name: str, x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """(a, b, k, rss): a and b by least squares for each k; k by a grid and golden-section search."""

    def solve(k: float):
        design = np.column_stack([np.ones_like(x), _shape(name, x, k)])
        coef, *_ = np.linalg.lstsq(design, y, rcond=None)
        return coef, float(((y - design @ coef) ** 2).sum())

    grid = np.linspace(x.min() + 1, x.max(), 25) if name == "plateau" else np.geomspace(0.01, 2, 25)
    losses = [solve(k)[1] for k in grid]
    best = int(np.argmin(losses))
    low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        p, q = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, q) if solve(p)[1] < solve(q)[1] else (p, high)
    k = min((low + high) / 2, grid[best], key=lambda v: solve(v)[1])
    (a, b), rss = solve(k)
    return float(a), float(b), float(k), rss


def saturation_fits(rows: DataFrame, key: list[str], x: str = "step", y: str = "value", least: int = 6) -> DataFrame:
    """key, model, n, a, b, k, rss, aicc, best: every model's fit to each series with `least` points, and the best by AICc."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[[*key, x, y]].dropna().sort_values(x)
        xs, ys, out = pdf[x].to_numpy(float), pdf[y].to_numpy(float), []
        if len(xs) >= least:
            for name in MODELS:
                a, b, k, rss = fit_shape(name, xs, ys)
                n, p = len(xs), 4
                aicc = n * np.log(max(rss, 1e-300) / n) + 2 * p + 2 * p * (p + 1) / max(n - p - 1, 1)
                out.append([*(pdf[c].iloc[0] for c in key), name, n, a, b, k, rss, aicc])
        frame = pd.DataFrame(out, columns=[*key, "model", "n", "a", "b", "k", "rss", "aicc"])
        frame["best"] = frame["aicc"] == frame["aicc"].min()
        return frame

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)
    return rows.select(*key, x, y).groupBy(*key).applyInPandas(fit, f"{kinds}, model string, n long, a double, b double, k double, rss double, aicc double, best boolean")


def block_permutation_p(rows: DataFrame, key: list[str], block: int = 4, replicates: int = 200, seed: int = 3) -> DataFrame:
    """key, slope, p: is a trend's slope larger than those of residuals rotated in blocks? Seeded by the series' name."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("step")
        x, y = pdf["step"].to_numpy(float), pdf["value"].to_numpy(float)
        if len(x) < 2 * block:
            return pd.DataFrame(columns=[*key, "slope", "p"])
        r = np.random.default_rng([seed, *"/".join(str(pdf[c].iloc[0]) for c in key).encode()])
        x = x - x.mean()
        slope = float(x @ y / (x @ x))
        rest = y - y.mean() - slope * x
        n, far = len(y), 0
        for _ in range(replicates):
            starts = r.integers(0, n, -(-n // block))
            drawn = np.concatenate([rest[(s + np.arange(block)) % n] for s in starts])[:n]
            far += abs(x @ drawn / (x @ x)) >= abs(slope) - 1e-15
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in key), slope, (far + 1) / (replicates + 1)]], columns=[*key, "slope", "p"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)
    return rows.select(*key, "step", "value").groupBy(*key).applyInPandas(test, f"{kinds}, slope double, p double")


def shuffle_permutation_p(rows: DataFrame, key: list[str], replicates: int = 200, seed: int = 9, least: int = 4) -> DataFrame:
    """key, n, r, p: is a series' correlation with its steps larger than those of its values in random order? p = (c + 1) / (B + 1)."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("step")
        x, y = pdf["step"].to_numpy(float), pdf["value"].to_numpy(float)
        if len(x) < least or np.ptp(x) == 0 or np.ptp(y) == 0:
            return pd.DataFrame(columns=[*key, "n", "r", "p"])
        x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
        g = np.random.default_rng([seed, *"/".join(str(pdf[c].iloc[0]) for c in key).encode()])
        r = float(x @ y / len(x))
        far = sum(abs(float(x @ g.permutation(y)) / len(x)) >= abs(r) - 1e-12 for _ in range(replicates))
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in key), len(x), r, (far + 1) / (replicates + 1)]], columns=[*key, "n", "r", "p"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)
    return rows.select(*key, "step", "value").groupBy(*key).applyInPandas(test, f"{kinds}, n long, r double, p double")
