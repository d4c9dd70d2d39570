"""Laws of distances by likelihood, from counts in log bins: only the counts reach the driver."""

from __future__ import annotations

from dataclasses import dataclass
from math import erf, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Density shapes over distance x, and their parameters (all positive) with starting values.
FAMILIES = {
    "powerlaw": (lambda x, b: -b * np.log(x), {"beta": 1.5}),
    "shifted_powerlaw": (lambda x, r, b: -b * np.log(x + r), {"r0": 1.0, "beta": 1.5}),
    "exponential": (lambda x, k: -x / k, {"kappa": 10.0}),
    "lognormal": (lambda x, m, s: -np.log(x) - (np.log(x) - np.log(m)) ** 2 / (2 * s * s), {"median": 3.0, "sigma": 1.0}),
    "truncated_powerlaw": (lambda x, r, b, k: -b * np.log(x + r) - x / k, {"r0": 1.0, "beta": 1.5, "kappa": 50.0}),
}


def log_truncated_powerlaw(x: Column, c: float, r0: float, beta: float, kappa: float) -> Column:
    """ln of c * (x + r0) ** -beta * exp(-x / kappa)."""
    return F.lit(float(np.log(c))) - beta * F.ln(x + r0) - x / kappa


def log_counts(values: DataFrame, column: str, bins: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Edges of equal log width over the positive finite values, and the counts between them."""
    x = values.select(F.col(column).cast("double").alias("x")).where("x > 0 and not isnan(x) and x < double('infinity')")
    r = x.agg(F.min("x"), F.max("x")).first()
    if r[0] is None or r[0] == r[1]:
        raise ValueError("needs different positive values")
    lo, hi = np.log(r[0]), np.log(r[1])
    found = x.select(F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.ln("x") - float(lo)) / float(hi - lo) * bins).cast("int"))).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(bins)
    for b in found:
        counts[b["bin"]] = b["n"]
    return np.exp(np.linspace(lo, hi, bins + 1)), counts


def simplex(f, start: np.ndarray, steps: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """The Nelder-Mead minimum of f from start."""
    p = np.vstack([start, start + np.eye(len(start)) * 0.5])
    y = np.array([f(x) for x in p])
    for _ in range(steps):
        order = y.argsort(kind="stable")
        p, y = p[order], y[order]
        if abs(y[-1] - y[0]) <= tolerance * (abs(y[0]) + tolerance) and np.ptp(p, axis=0).max() < 1e-7:
            break
        mid = p[:-1].mean(0)
        new = 2 * mid - p[-1]
        v = f(new)
        if v < y[0]:
            far = 3 * mid - 2 * p[-1]
            w = f(far)
            new, v = (far, w) if w < v else (new, v)
        elif v >= y[-2]:
            new = (mid + (new if v < y[-1] else p[-1])) / 2
            w = f(new)
            if w >= min(v, y[-1]):
                p[1:] = (p[1:] + p[0]) / 2
                y[1:] = [f(x) for x in p[1:]]
                continue
            v = w
        p[-1], y[-1] = new, v
    return p[y.argmin()]


def fit_counts(edges: np.ndarray, counts: np.ndarray, family: str) -> dict:
    """Maximum-likelihood parameters of a family on binned counts, with AIC, BIC and the Kolmogorov-Smirnov distance."""
    shape, start = FAMILIES[family]
    inner = np.exp(np.linspace(np.log(edges[:-1]), np.log(edges[1:]), 5))  # 5 places in each bin, Simpson twice

    def shares(u):
        with np.errstate(all="ignore"):
            y = shape(inner, *np.exp(np.clip(u, -20, 20))) + np.log(inner)
            y = np.exp(y - np.nanmax(y))
        mass = y.T @ np.array([1, 4, 2, 4, 1.0]) * np.log(edges[1] / edges[0])
        return mass / mass.sum() if np.isfinite(mass).all() and mass.sum() > 0 else np.full(len(counts), 1e-300)

    def loss(u):
        return -(counts * np.log(np.maximum(shares(u), 1e-300))).sum()

    first = np.log(np.array(list(start.values())))
    tries = [simplex(loss, first + s) for s in (0.0, 1.0, -1.0)]
    best = simplex(loss, min(tries, key=loss))
    k, n, ll = len(first), counts.sum(), -loss(best)
    gap = np.abs(np.cumsum(shares(best)) - np.cumsum(counts) / n).max()
    return {"family": family, **{name: float(v) for name, v in zip(start, np.exp(np.clip(best, -20, 20)), strict=True)}, "log_likelihood": float(ll), "aic": float(2 * k - 2 * ll), "bic": float(k * np.log(n) - 2 * ll), "ks": float(gap), "n": int(n)}


def fit_distance_distribution(values: DataFrame, column: str, family: str = "truncated_powerlaw", bins: int = 200) -> dict:
    """One family; needs 20 positive finite values."""
    edges, counts = log_counts(values, column, bins)
    if counts.sum() < 20:
        raise ValueError("needs 20 positive values")
    return fit_counts(edges, counts, family)


def compare_distance_distributions(values: DataFrame, column: str, families=tuple(FAMILIES), bins: int = 200) -> DataFrame:
    """All families by rising AIC: family, parameters (a map), log_likelihood, aic, bic, ks."""
    edges, counts = log_counts(values, column, bins)
    got = sorted((fit_counts(edges, counts, f) for f in families), key=lambda r: (r["aic"], r["family"]))
    rows = [(r["family"], {p: r[p] for p in FAMILIES[r["family"]][1]}, r["log_likelihood"], r["aic"], r["bic"], r["ks"]) for r in got]
    return values.sparkSession.createDataFrame(rows, "family string, parameters map<string,double>, log_likelihood double, aic double, bic double, ks double")


def vuong_test(edges: np.ndarray, counts: np.ndarray, first: str, second: str) -> float:
    """z of the mean difference of log-likelihoods of two families, corrected by AIC; positive favours the first."""
    parts = []
    for family in (first, second):
        shape, start = FAMILIES[family]
        r = fit_counts(edges, counts, family)
        mid = np.sqrt(edges[:-1] * edges[1:])
        y = shape(mid, *[r[p] for p in start]) + np.log(mid)
        parts.append((y - np.log(np.exp(y - y.max()).sum()) - y.max(), len(start)))
    d, n = parts[0][0] - parts[1][0], counts.sum()
    mean = (counts * d).sum() / n
    var = (counts * (d - mean) ** 2).sum() / n
    return float((n * mean - (parts[0][1] - parts[1][1])) / np.sqrt(n * var)) if var > 0 else 0.0


def chi_square_bound(confidence: float) -> float:
    """The value that a chi-square variable of one degree of freedom stays below with this chance."""
    lo, hi = 0.0, 100.0
    while hi - lo > 1e-10:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if erf(sqrt(mid / 2)) < confidence else (lo, mid)
    return (lo + hi) / 2


@dataclass(frozen=True)
class DistributionFit:
    """A family fitted to binned distances: density, distribution, intervals and a table of the estimates."""

    family: str
    parameters: dict[str, float]
    edges: np.ndarray
    counts: np.ndarray
    log_likelihood: float
    aic: float
    bic: float
    ks: float

    @classmethod
    def fit(cls, values: DataFrame, column: str, family: str = "truncated_powerlaw", bins: int = 200) -> DistributionFit:
        return cls.of(*log_counts(values, column, bins), family)

    @classmethod
    def of(cls, edges: np.ndarray, counts: np.ndarray, family: str) -> DistributionFit:
        if counts.sum() < 20:
            raise ValueError("needs 20 positive values")
        r = fit_counts(edges, counts, family)
        return cls(family, {p: r[p] for p in FAMILIES[family][1]}, edges, counts, r["log_likelihood"], r["aic"], r["bic"], r["ks"])

    def _grid(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A fine grid of distances over the fitted range, the density there, and the share up to each."""
        x = np.exp(np.linspace(np.log(self.edges[0]), np.log(self.edges[-1]), 20_001))
        y = FAMILIES[self.family][0](x, *self.parameters.values())
        y = np.exp(y - y.max())
        part = np.append(0, np.cumsum((y[1:] + y[:-1]) / 2 * np.diff(x)))
        return x, y / part[-1], part / part[-1]

    def pdf(self, x) -> np.ndarray:
        """Density at x; 0 outside the fitted range."""
        at, y, _ = self._grid()
        x = np.asarray(x, float)
        return np.where((x >= at[0]) & (x <= at[-1]), np.exp(np.interp(np.log(np.maximum(x, 1e-300)), np.log(at), np.log(np.maximum(y, 1e-300)))), 0.0)

    def cdf(self, x) -> np.ndarray:
        """Share of distances up to x, on straight lines over the logarithm of x."""
        at, _, share = self._grid()
        return np.interp(np.log(np.maximum(np.asarray(x, float), 1e-300)), np.log(at), share)

    def profile(self, parameter: str, confidence: float = 0.95) -> tuple[float | None, float | None]:
        """Profile-likelihood interval of a parameter by bisection; None at an end where the likelihood never falls enough."""
        names = list(self.parameters)
        k = names.index(parameter)
        shape = FAMILIES[self.family][0]
        inner = np.exp(np.linspace(np.log(self.edges[:-1]), np.log(self.edges[1:]), 5))
        start = np.log(np.array([self.parameters[n] for n in names if n != parameter]))

        def loss(others, fixed):
            p = np.insert(np.exp(np.clip(others, -20, 20)), k, fixed)
            with np.errstate(all="ignore"):
                y = shape(inner, *p) + np.log(inner)
                y = np.exp(y - np.nanmax(y))
            mass = y.T @ np.array([1, 4, 2, 4, 1.0])
            return -(self.counts * np.log(np.maximum(mass / mass.sum(), 1e-300))).sum() if np.isfinite(mass).all() and mass.sum() > 0 else 1e300

        def best(fixed):
            return loss(simplex(lambda u: loss(u, fixed), start, 300), fixed) if len(start) else loss(start, fixed)

        top, bound = -best(self.parameters[parameter]), chi_square_bound(confidence) / 2
        ends = []
        for way in (-1, 1):
            near, far = 0.0, 0.05
            while top + best(self.parameters[parameter] * np.exp(way * far)) < bound and far < 12:
                near, far = far, far * 2
            if far >= 12:
                ends.append(None)
                continue
            for _ in range(25):
                mid = (near + far) / 2
                near, far = (mid, far) if top + best(self.parameters[parameter] * np.exp(way * mid)) < bound else (near, mid)
            ends.append(float(self.parameters[parameter] * np.exp(way * far)))
        return ends[0], ends[1]

    def summary(self, spark: SparkSession, confidence: float = 0.95) -> DataFrame:
        """parameter, estimate, low, high: one row a parameter."""
        rows = [(self.family, n, v, *self.profile(n, confidence)) for n, v in self.parameters.items()]
        return spark.createDataFrame(rows, "family string, parameter string, estimate double, low double, high double")


def likelihood_ratio_test(values: DataFrame, column: str, first: str, second: str, bins: int = 200) -> dict:
    """Vuong's z of two families and its two-sided p value; positive z favours the first."""
    z = vuong_test(*log_counts(values, column, bins), first, second)
    return {"first": first, "second": second, "z": z, "p": float(1 - erf(abs(z) / sqrt(2)))}


def select_xmin(values: DataFrame, column: str, family: str = "truncated_powerlaw", candidates: list[float] | None = None, n_candidates: int = 30, min_values: int = 100, bins: int = 200) -> dict:
    """The least distance from which the family fits best: of the candidates (edges of the bins, evenly spaced by default) the one of least Kolmogorov-Smirnov distance with min_values beyond it."""
    edges, counts = log_counts(values, column, bins)
    at = sorted({int(np.searchsorted(edges[:-1], c)) for c in candidates}) if candidates else sorted(set(np.linspace(0, bins - 2, n_candidates).astype(int).tolist()))
    tried = [(fit_counts(edges[i:], counts[i:], family), i) for i in at if i < bins - 1 and counts[i:].sum() >= min_values]
    if not tried:
        raise ValueError(f"no candidate has {min_values} values beyond it")
    fit, i = min(tried, key=lambda t: (t[0]["ks"], t[1]))
    return {"xmin": float(edges[i]), **fit}
