"""Fitting the gravity model, agents that explore and return, and diaries of being at home or away.

Agents are independent: each has its own seeded stream, so a lost task gives the same agents again.
The catalogue of places reaches every task and is held below MAX_PLACES.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import _km

#: Bound of the catalogue that agents carry along.
MAX_PLACES = 20000


def gravity_fit(flows: DataFrame, places: DataFrame, include_zeros: bool = True, steps: int = 25, tolerance: float = 1e-9) -> dict:
    """Exponents of relevance and distance of the singly constrained model, by Poisson likelihood with a level for each origin.

    With the levels solved, each origin's flows are shares of its total; every Newton step is one aggregation.
    flows(origin, destination, flow), places(location_id, lat, lng, relevance). Returns alpha, beta, their errors, the
    log-likelihood of the shares, and the number of pairs. Self loops and places without relevance are left out.
    """
    at = places.where("relevance > 0").select("location_id", F.radians("lat").alias("y"), F.radians("lng").alias("x"), F.ln("relevance").alias("m"))
    o, d = (at.select(*[F.col(c).alias(f"{p}{c}") for c in at.columns]) for p in "od")
    arc = F.sin((F.col("dy") - F.col("oy")) / 2) ** 2 + F.cos("oy") * F.cos("dy") * F.sin((F.col("dx") - F.col("ox")) / 2) ** 2
    pairs = o.join(d, F.col("olocation_id") != F.col("dlocation_id")).select(F.col("olocation_id").alias("origin"), F.col("dlocation_id").alias("destination"), F.col("dm").alias("a"), F.ln(2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), arc)))).alias("b"))
    total = flows.where("origin != destination").groupBy("origin", "destination").agg(F.sum("flow").alias("flow"))
    seen = pairs.join(total, ["origin", "destination"], "left" if include_zeros else "inner").select("origin", "a", "b", F.coalesce("flow", F.lit(0.0)).alias("y")).where("b is not null").cache()
    theta, cov, fit = np.zeros(2), np.zeros((2, 2)), (0, 0.0)
    for _ in range(steps):
        w = F.exp(F.col("a") * float(theta[0]) + F.col("b") * float(theta[1]))
        one = seen.withColumn("w", w).groupBy("origin").agg(F.sum("y").alias("y"), F.sum("w").alias("w"), *[F.sum(F.col("w") * e).alias(n) for n, e in (("wa", F.col("a")), ("wb", F.col("b")), ("waa", F.col("a") ** 2), ("wab", F.col("a") * F.col("b")), ("wbb", F.col("b") ** 2))], F.sum(F.col("y") * F.col("a")).alias("ya"), F.sum(F.col("y") * F.col("b")).alias("yb"), F.count("*").alias("n"))
        a, b, y = F.col("wa") / F.col("w"), F.col("wb") / F.col("w"), F.col("y")
        r = one.agg(F.sum(F.col("ya") - y * a), F.sum(F.col("yb") - y * b), F.sum(y * (F.col("waa") / F.col("w") - a * a)), F.sum(y * (F.col("wab") / F.col("w") - a * b)), F.sum(y * (F.col("wbb") / F.col("w") - b * b)), F.sum(F.col("ya") * float(theta[0]) + F.col("yb") * float(theta[1]) - y * F.ln("w")), F.sum("n")).first()
        if r[6] is None:
            break
        fit = r[6], r[5]
        cov = np.linalg.pinv(np.array([[r[2], r[3]], [r[3], r[4]]]))
        step = cov @ np.array([r[0], r[1]])
        theta = theta + step
        if np.abs(step).max() < tolerance:
            break
    seen.unpersist()
    return {"alpha": float(theta[0]), "beta": float(theta[1]), "alpha_error": float(np.sqrt(cov[0, 0])), "beta_error": float(np.sqrt(cov[1, 1])), "log_likelihood": float(fit[1]), "pairs": int(fit[0])}


def origin_indicators(flows: DataFrame, places: DataFrame) -> DataFrame:
    """flows with at, the position of the origin in the order of the catalogue's ids, and indicators: 1 there and 0 elsewhere."""
    ids, *_ = _catalogue(places, None)
    order = F.array(*[F.lit(x.item() if hasattr(x, "item") else x) for x in ids])
    at = F.array_position(order, F.col("origin")) - 1
    return flows.withColumn("at", at.cast("int")).withColumn("indicators", F.transform(F.sequence(F.lit(0), F.lit(len(ids) - 1)), lambda i: F.when(i == F.col("at"), 1).otherwise(0)))


def _catalogue(places: DataFrame, relevance: str | None):
    """Ids, coordinates and weights of at most MAX_PLACES places."""
    rows = places.select("location_id", "lat", "lng", F.col(relevance).cast("double").alias("m") if relevance else F.lit(1.0).alias("m")).where("m > 0").orderBy("location_id").limit(MAX_PLACES + 1).toPandas()
    if len(rows) > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} places; agents carry the catalogue along")
    if rows.empty:
        raise ValueError("no places")
    return rows["location_id"].to_numpy(), rows["lat"].to_numpy(float), rows["lng"].to_numpy(float), rows["m"].to_numpy(float)


def _wait(rng, beta: float, tau: float, least: float) -> float:
    """Hours from a power law of exponent 1 + beta cut off at tau, by rejection."""
    while True:
        hours = least * (1 - rng.random()) ** (-1 / beta)
        if rng.random() < np.exp(-(hours - least) / tau):
            return hours


def _choose(rng, now: int, visits: dict, pull, rho: float, gamma: float, places: int) -> int:
    """Next place: explore by gravity with probability rho * S ** -gamma, else return by counts of visits, never to the same place."""
    if len(visits) == 1 or (len(visits) < places and rng.random() <= rho * len(visits) ** -gamma):
        p = pull(now)
        return int(rng.choice(len(p), p=p)) if p is not None else now
    back = [k for k in visits if k != now]
    n = np.array([visits[k] for k in back], float)
    return int(back[rng.choice(len(back), p=n / n.sum())])


def _agents(spark: SparkSession, n_agents: int, catalogue, beta_gravity: float, walk) -> DataFrame:
    ids, lat, lng, m = catalogue
    shared = spark.sparkContext.broadcast((ids, lat, lng, m))

    def run(frames):
        ids, lat, lng, m = shared.value
        known: dict = {}

        def pull(i):
            if i not in known:
                d = _km(lat[i], lng[i], lat, lng)
                w = np.where(d > 0, m * np.where(d > 0, d, 1) ** beta_gravity, 0.0)
                known[i] = w / w.sum() if w.sum() > 0 else None
            return known[i]

        for part in frames:
            for agent in part["id"]:
                rows = walk(int(agent), pull, m)
                at = np.array([k for _, k in rows])
                yield pd.DataFrame({"uid": agent, "datetime": pd.to_datetime([t for t, _ in rows]), "location_id": ids[at], "lat": lat[at], "lng": lng[at]})

    kind = "string" if ids.dtype == object else "bigint"
    return spark.range(n_agents).mapInPandas(run, f"uid bigint, datetime timestamp_ntz, location_id {kind}, lat double, lng double")


def epr(places: DataFrame, start: dt.datetime, end: dt.datetime, n_agents: int = 1, rho: float = 0.6, gamma: float = 0.21, beta: float = 0.8, tau: float = 17.0, min_wait_minutes: float = 20.0, gravity_beta: float = -2.0, relevance: str | None = "relevance", seed: int = 42) -> DataFrame:
    """Visits of agents that explore and return preferentially (relevance=None: places pull by distance alone)."""

    def walk(agent, pull, m):
        rng = np.random.default_rng([seed, agent])
        now, t, visits = int(rng.choice(len(m), p=m / m.sum())), start, {}
        out = []
        while t < end:
            out.append((t, now))
            visits[now] = visits.get(now, 0) + 1
            t += dt.timedelta(hours=_wait(rng, beta, tau, min_wait_minutes / 60))
            now = _choose(rng, now, visits, pull, rho, gamma, len(m))
        return out

    return _agents(places.sparkSession, n_agents, _catalogue(places, relevance), gravity_beta, walk)


class MarkovDiary:
    """When a person is at home or away: transitions between (hour of day, at home) learned from fixes of whole hours."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # 48 x 48; state = 2 * hour + away

    @classmethod
    def fit(cls, fixes: DataFrame, place: str = "place") -> MarkovDiary:
        """Home is a user's most frequent place; an hour's place is its most frequent one, the one before where there is none.

        A stay of k hours away is one transition to the hour k later. Only the 48 x 48 counts reach the driver.
        """
        slots = fixes.where(F.col(place).isNotNull() & F.col("datetime").isNotNull()).groupBy("uid", F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', datetime)").alias("slot"), F.col(place).cast("string").alias("place")).agg(F.count("*").alias("n"))

        def walk(p):
            overall = p.groupby("place")["n"].sum()
            p = p.assign(all=p["place"].map(overall)).sort_values(["slot", "n", "all", "place"], ascending=[True, False, False, True]).drop_duplicates("slot")
            home = min(overall.index, key=lambda x: (-overall[x], x))
            line = p.set_index("slot")["place"].reindex(range(int(p["slot"].min()), int(p["slot"].max()) + 1)).ffill()
            away, hour, where = (line != home).to_numpy(), line.index.to_numpy() % 24, line.to_numpy()
            out, i = {}, 0
            while i < len(line) - 1:
                j = i + 1
                while away[i] and j < len(line) - 1 and where[j] == where[i]:
                    j += 1
                key = (int(2 * hour[i] + away[i]), int(2 * hour[j] + away[j]))
                out[key] = out.get(key, 0) + 1
                i = j
            return pd.DataFrame([(a, b, n) for (a, b), n in out.items()], columns=["a", "b", "n"])

        counts = np.zeros((48, 48))
        for r in slots.groupBy("uid").applyInPandas(walk, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
            counts[r["a"], r["b"]] = r["n"]
        return cls(counts)

    def generate(self, hours: int, start: dt.datetime, seed: int = 42) -> list[tuple[dt.datetime, int]]:
        """(time, 0 at home or the number of the place away), one row at each change; places are numbered anew after each stay at home."""
        rng = np.random.default_rng(seed)
        state, out, h, number = 0, [(start, 0)], 0, 0
        while h < hours:
            row = self.counts[state]
            new = int(rng.choice(48, p=row / row.sum())) if row.sum() else (state + 2) % 48
            step = (new // 2 - state // 2) % 24 or 24
            h, state = h + step, new
            number = number + 1 if state % 2 else 0
            if h < hours and out[-1][1] != number:
                out.append((start + dt.timedelta(hours=h), number))
        return out


def ditras(places: DataFrame, diary: MarkovDiary, start: dt.datetime, end: dt.datetime, n_agents: int = 1, rho: float = 0.3, gamma: float = 0.21, gravity_beta: float = -2.0, seed: int = 42) -> DataFrame:
    """Agents whose diary says when they are home; where they go else is chosen as by exploring agents."""
    hours = int((end - start).total_seconds() // 3600)

    def walk(agent, pull, m):
        rng = np.random.default_rng([seed, agent])
        home = now = int(rng.choice(len(m), p=m / m.sum()))
        out, visits = [], {}
        for t, number in diary.generate(hours, start, [seed, agent, 2]):
            now = _choose(rng, now, visits, pull, rho, gamma, len(m)) if number and visits else home
            out.append((t, now))
            visits[now] = visits.get(now, 0) + 1
        return out

    return _agents(places.sparkSession, n_agents, _catalogue(places, "relevance"), gravity_beta, walk)
