"""How sure are fitted curves: bootstraps of their residuals, and the room that they leave above a series' last value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curves import MODELS, saturation_fits

#: Quantiles of the bootstrapped plateaus, and of the steps from the last one to 90 % of the way.
QUANTILES = {"lo": 0.025, "q16": 0.16, "mid": 0.5, "q84": 0.84, "hi": 0.975}
#: A level that is reached more than so many steps after the last one counts as not reached.
AHEAD = 100_000.0
_RATIO = (5**0.5 - 1) / 2


def shapes(model: str, x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A model's curve of level 0 and size 1, a row for each k."""
    return MODELS[model](x[None, :], 0.0, 1.0, k[:, None])


def _solved(model: str, x: np.ndarray, ys: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, rss) by least squares, of each row of ys with its own k."""
    s = shapes(model, x, k)
    level = s.mean(axis=1, keepdims=True)
    spread = ((s - level) ** 2).sum(axis=1)
    flat = spread <= 1e-24 * len(x)
    b = np.where(flat, 0.0, ((s - level) * ys).sum(axis=1) / np.where(flat, 1.0, spread))
    a = ys.mean(axis=1) - b * level[:, 0]
    return a, b, ((ys - a[:, None] - b[:, None] * s) ** 2).sum(axis=1)


def refits(model: str, x: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, k) of each row of ys: curves.fit_shape on all rows at once, by the same grid and golden-section search."""
    grid = np.linspace(x.min() + 1, x.max(), 25) if model == "plateau" else np.geomspace(0.01, 2, 25)
    loss = lambda k: _solved(model, x, ys, k)[2]
    best = np.argmin([loss(np.full(len(ys), k)) for k in grid], axis=0)
    low, high = grid[np.maximum(best - 1, 0)], grid[np.minimum(best + 1, len(grid) - 1)]
    for _ in range(40):
        p, q = high - _RATIO * (high - low), low + _RATIO * (high - low)
        left = loss(p) < loss(q)
        low, high = np.where(left, low, p), np.where(left, q, high)
    middle = (low + high) / 2
    k = np.where(loss(middle) <= loss(grid[best]), middle, grid[best])
    a, b, _ = _solved(model, x, ys, k)
    return a, b, k


def plateau(model: str, a, b, k):
    """Where a curve ends."""
    return a + b * k if model == "plateau" else a + b


def reached(model: str, x: np.ndarray, y0: float, a, b, k, share: float = 0.9) -> np.ndarray:
    """The x from x[0] on at which curves have gone `share` of the way from y0 to their plateaus, by the curve's inverse.

    NaN where the plateau isn't above y0, or the place is over AHEAD beyond the last x.
    """
    end = plateau(model, a, b, k)
    target = y0 + share * (end - y0)
    with np.errstate(all="ignore"):
        q = (target - a) / b
        if model == "exponential":
            at = -np.log1p(-q) / k
        elif model == "logistic":
            at = x.mean() - np.log(1 / q - 1) / k
        elif model == "gompertz":
            at = x.mean() - np.log(-np.log(q)) / k
        else:
            at = q
        at = np.where((b <= 0) | (q <= 0), x[0], np.maximum(at, x[0]))
        return np.where((end > y0) & (at <= x[-1] + AHEAD), at, np.nan)


def drawn(name: str, replicate: int, n: int, seed: int) -> np.ndarray:
    """Which residual each of n points of a replicate gets: by the series' name and the replicate alone."""
    return np.random.default_rng([seed, replicate, *name.encode()]).integers(0, n, n)


def bootstrapped_fits(rows: DataFrame, key: list[str], x: str = "step", y: str = "value", replicates: int = 500, block: int = 100, seed: int = 11, least: int = 6) -> DataFrame:
    """key, model and the fit (n, a, b, k, rss, aicc) with what its residuals leave open, a row for each model of each series.

    plateau; x90: steps from the last one until 90 % of the way from the first value to the plateau is gone (NULL: never);
    first_value, last_value, least_value, most_value; n_ok: replicates with a finite plateau; plateau_* and x90_* at
    QUANTILES, n_x90; far_above: the share of plateaus more than the values' range above their maximum.

    A replicate adds centred residuals, drawn with replacement, to the fitted curve and is fitted anew. Replicates are
    dealt to tasks in blocks, so that a few long series don't bind the work to a few tasks; draws depend on the series'
    name, the model and the replicate alone, and not on blocks or partitions. Series of fewer than `least` points with a
    value have no rows; equal values or a perfect fit give intervals of no width.
    """
    points = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("points"))
    fits = saturation_fits(rows, key, x, y, least).drop("best").join(points, key)
    dealt = fits.select(*key, "model", "a", "b", "k", "points", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // block))).alias("block"))

    def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                xs, ys = np.array([p["x"] for p in r.points]), np.array([p["y"] for p in r.points])
                curve = MODELS[r.model](xs, r.a, r.b, r.k)
                rest = ys - curve
                rest -= rest.mean()
                name = "/".join(str(getattr(r, c)) for c in (*key, "model"))
                numbers = range(r.block * block, min((r.block + 1) * block, replicates))
                a, b, k = refits(r.model, xs, np.array([curve + rest[drawn(name, i, len(xs), seed)] for i in numbers]))
                ends = plateau(r.model, a, b, k)
                ok = np.isfinite(ends)
                steps = (reached(r.model, xs, ys[0], a, b, k) - xs[-1])[ok]
                out.append([*(getattr(r, c) for c in key), r.model, ends[ok], [None if np.isnan(s) else s for s in steps], float(reached(r.model, xs, ys[0], *map(np.float64, (r.a, r.b, r.k))) - xs[-1])])
            yield pd.DataFrame(out, columns=[*key, "model", "plateaus", "steps", "x90"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    again = dealt.repartition(*key, "model", "block").mapInPandas(refit, f"{kinds}, model string, plateaus array<double>, steps array<double>, x90 double")
    lists = again.groupBy(*key, "model").agg(  # `replicates` numbers
        *(F.flatten(F.collect_list(c)).alias(c) for c in ("plateaus", "steps")), F.nanvl(F.first("x90"), F.lit(None).cast("double")).alias("x90")
    )
    value = lambda f: f(F.transform("points", lambda p: p["y"]))
    found = fits.join(lists, [*key, "model"]).withColumns({
        "plateau": F.col("a") + F.col("b") * F.when(F.col("model") == "plateau", F.col("k")).otherwise(1.0),
        "first_value": value(lambda v: F.get(v, F.lit(0))), "last_value": value(lambda v: F.element_at(v, -1)), "least_value": value(F.array_min), "most_value": value(F.array_max),
        "plateaus": F.array_sort("plateaus"), "steps": F.array_sort(F.filter("steps", lambda s: s.isNotNull())),
    }).withColumns({"n_ok": F.size("plateaus"), "n_x90": F.size("steps")})
    far = F.col("most_value") + F.greatest(F.col("most_value") - F.col("least_value"), F.lit(1e-9))
    return found.select(
        *key, "model", "n", "a", "b", "k", "rss", "aicc", "first_value", "last_value", "least_value", "most_value", "plateau", "x90", "n_ok",
        *(_quantile("plateaus", q).alias(f"plateau_{name}") for name, q in QUANTILES.items()), F.try_divide(F.size(F.filter("plateaus", lambda p: p > far)), F.col("n_ok")).alias("far_above"), "n_x90",
        *(_quantile("steps", q).alias(f"x90_{name}") for name, q in QUANTILES.items()),
    )


def _quantile(values: str, q: float):
    """The quantile of an ascending array, linear between neighbours; NULL of an empty one."""
    place = F.lit(q) * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    one, two = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return one + (two - one) * (place - low)


def with_headroom(fits: DataFrame) -> DataFrame:
    """bootstrapped_fits with width, range, identifiable, headroom and headroom_max (above the last and the largest value) and their limits, and inside.

    identifiable: the plateau's interval is at most twice as wide as the values' range; inside: it holds the last value.
    """
    span = F.greatest(F.col("most_value") - F.col("least_value"), F.lit(1e-9))
    found = fits.withColumns({"width": F.col("plateau_hi") - F.col("plateau_lo"), "range": span})
    return found.withColumns({
        "identifiable": F.col("width") <= 2 * F.col("range"), "width_over_range": F.col("width") / F.col("range"),
        **{f"headroom{name}{limit}": F.col(f"plateau{limit}") - F.col(above) for name, above in (("", "last_value"), ("_max", "most_value")) for limit in ("", "_lo", "_hi")},
        "inside": F.col("last_value").between(F.col("plateau_lo"), F.col("plateau_hi")),
    })


def saturation_verdicts(fits: DataFrame, noise: DataFrame, key: list[str]) -> DataFrame:
    """A row for each series: which models are best and identifiable, whether they agree on the plateau, and whether its headroom exceeds the noise.

    fits: with_headroom; noise: key, mde (the least change between two steps that counts), at most one row a key. best,
    best_identifiable: of least AICc (of equal ones the first by name; NULL: none); spread, spread_identifiable: of the
    plateaus; common_lo, common_hi, overlap: what all intervals share; identifiable_lo, identifiable_hi: what those of
    identifiable models reach together; n_* counts models; headroom_over_mde: of the best model (NULL: no mde, or 0).
    """
    rows = fits.join(noise.select(*key, F.nullif("mde", F.lit(0.0)).alias("mde")), key, "left").withColumn("exceeds", F.col("headroom") > F.col("mde"))
    sure = F.col("identifiable")
    when = lambda c: F.when(sure, F.col(c))
    order = F.struct("aicc", "model")
    found = rows.groupBy(*key).agg(
        F.first("n").alias("n"), F.first("last_value").alias("last_value"), F.first("most_value").alias("most_value"), F.first("mde").alias("mde"),
        F.min_by("model", order).alias("best"), F.min_by(when("model"), F.when(sure, order)).alias("best_identifiable"), F.array_join(F.array_sort(F.collect_set(when("model"))), ",").alias("identifiable"),
        (F.max("plateau") - F.min("plateau")).alias("spread"), (F.max(when("plateau")) - F.min(when("plateau"))).alias("spread_identifiable"),
        F.max("plateau_lo").alias("common_lo"), F.min("plateau_hi").alias("common_hi"), F.min(when("plateau_lo")).alias("identifiable_lo"), F.max(when("plateau_hi")).alias("identifiable_hi"),
        F.count("*").alias("n_models"), F.count_if(sure).alias("n_identifiable"), F.count_if("inside").alias("n_inside"), F.count_if(sure & F.col("inside")).alias("n_identifiable_inside"),
        F.count_if("exceeds").alias("n_exceeds"), F.count_if(sure & F.col("exceeds")).alias("n_identifiable_exceeds"),
        F.min_by(F.struct("plateau", "headroom", "headroom_lo", "headroom_hi", "x90"), order).alias("_top"),
    )
    found = found.withColumns({"overlap": F.col("common_lo") <= F.col("common_hi"), "headroom_over_mde": F.col("_top.headroom") / F.col("mde")})
    return found.select(*(c for c in found.columns if c != "_top"), "_top.*")
