"""Walks over one user's fixes, continued: loops, interpolation, optimal simplification, triplegs, clusters, distances between users."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import components
from ..functions.geo import EARTH_KM, valid
from .kernels import _km, _per_user, _per_user_columns, _starts, filter_speed
from .walks import _KEPT, _kmh, _masked, _planar, _stays, _uid, _within


def _times(seconds) -> pd.DatetimeIndex:
    return pd.to_datetime(np.rint(np.asarray(seconds, float) * 1e6).astype("int64"), unit="us")


def filter_loops(fixes: DataFrame, max_speed_kmh: float = 500.0, speed_kmh: float = 5.0, max_loop: int = 6, ratio_max: float = 0.25) -> DataFrame:
    """The speed filter, then loops: of up to max_loop fixes after one, the first that returns below ratio_max of the
    largest distance closes a loop, and its farthest fix goes where the loop's mean speed is above speed_kmh."""

    def keep(t, lat, lng):
        out, i, n = np.ones(len(t), bool), 0, len(t)
        # Distances from each fix to the next ones, all at once; beyond the end none returns.
        after = np.arange(n)[:, None] + np.arange(1, max_loop + 1)
        near = np.minimum(after, n - 1)
        off = _km(lat[:, None], lng[:, None], lat[near], lng[near])
        returns = (off < ratio_max * np.maximum.accumulate(off, 1)) & (after < n)
        first, any_ = returns.argmax(1).tolist(), returns.any(1).tolist()
        step = _km(lat[:-1], lng[:-1], lat[1:], lng[1:])
        while i < n - 2:
            if any_[i]:
                k = i + 1 + first[i]
                way = step[i:k].sum()
                if t[k] > t[i] and way / (t[k] - t[i]) * 3600 > speed_kmh:
                    out[i + 1 + int(off[i, : first[i] + 1].argmax())] = False
                    i = k
                    continue
            i += 1
        return out

    return _masked(filter_speed(fixes, max_speed_kmh), keep)


def _spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline through (t, y) at the given places; y has a column for each axis."""
    h, n = np.diff(t), len(t)
    slope = np.diff(y, axis=0) / h[:, None]
    m, c, d = np.zeros_like(y), np.zeros(n), np.zeros_like(y)
    for i in range(1, n - 1):  # forward sweep of the tridiagonal system
        w = 2 * (h[i - 1] + h[i]) - h[i - 1] * c[i - 1]
        c[i] = h[i] / w
        d[i] = (6 * (slope[i] - slope[i - 1]) - h[i - 1] * d[i - 1]) / w
    for i in range(n - 2, 0, -1):
        m[i] = d[i] - c[i] * m[i + 1]
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    a, b, step = (t[k + 1] - at)[:, None], (at - t[k])[:, None], h[k][:, None]
    return (m[k] * a**3 + m[k + 1] * b**3) / (6 * step) + (y[k] / step - m[k] * step / 6) * a + (y[k + 1] / step - m[k + 1] * step / 6) * b


def interpolate(fixes: DataFrame, method: str = "cubic", sampling_rate_s: float = 3600.0, max_speed_kmh: float = 200.0, step_std_km: float = 0.05, seed: int = 42) -> DataFrame:
    """The fixes and, in each gap above the rate, one point at the rate after its start (event_id null).

    cubic: natural spline (a straight line below four distinct times); kinematic: the cubic that keeps position and
    velocity at both ends, a straight line where it would be faster than max_speed_kmh; random_walk: the line with a seeded
    displacement; linear: the line.
    """
    if method not in ("linear", "cubic", "kinematic", "random_walk"):
        raise ValueError(f"no method {method!r}")

    def walk(t, lat, lng, uid):
        y, gap = np.column_stack([lat, lng]), np.flatnonzero(np.diff(t) > sampling_rate_s)
        if not len(gap):
            return {"at": np.empty(0), "lat": np.empty(0), "lng": np.empty(0), "n": [0]}
        dt = np.diff(t)[gap][:, None]
        at, share = t[gap] + sampling_rate_s, sampling_rate_s / dt
        got = y[gap] + (y[gap + 1] - y[gap]) * share
        first = np.r_[True, np.diff(t) > 0]
        if method == "cubic" and first.sum() > 3:
            got = _spline(t[first], y[first], at)
        elif method == "kinematic":
            before = np.maximum(gap - 1, 0)
            past = np.where(gap > 0, t[gap] - t[before], 0)[:, None]
            v0 = np.where(past > 0, (y[gap] - y[before]) / np.where(past > 0, past, 1), 0.0)
            v1, s = (y[gap + 1] - y[gap]) / dt, share
            bend = (2 * s**3 - 3 * s**2 + 1) * y[gap] + (s**3 - 2 * s**2 + s) * dt * v0 + (3 * s**2 - 2 * s**3) * y[gap + 1] + (s**3 - s**2) * dt * v1
            slow = _km(y[gap, 0], y[gap, 1], bend[:, 0], bend[:, 1]) / sampling_rate_s * 3600 <= max_speed_kmh
            got = np.where(slow[:, None], bend, got)
        elif method == "random_walk":
            rng = np.random.default_rng([seed, int(pd.util.hash_array(np.array([str(uid)], object))[0] % 2**32)])
            far, turn = np.abs(rng.normal(0, step_std_km, len(gap))), rng.uniform(0, 2 * np.pi, len(gap))
            got = got + np.column_stack([far * np.cos(turn), far * np.sin(turn) / np.maximum(np.cos(np.radians(got[:, 0])), 1e-9)]) / (EARTH_KM * np.pi / 180)
        return {"at": at, "lat": got[:, 0], "lng": got[:, 1], "n": [len(gap)]}

    def finish(part, got):
        first = _starts(part["uid"])
        users, n = np.arange(len(first)), np.diff(np.r_[first, len(part)])
        new = pd.DataFrame({"uid": part["uid"].iloc[np.repeat(first, got["n"])].to_numpy(), "datetime": _times(got["at"]), "event_id": pd.array([None] * len(got["at"]), "Int64"), "lat": got["lat"], "lng": got["lng"]}).astype({"uid": part["uid"].dtype})
        both = pd.concat([part.astype({"event_id": "Int64"}), new], ignore_index=True)
        user = np.concatenate([np.repeat(users, n), np.repeat(users, got["n"])])
        return both.iloc[np.lexsort((both["datetime"].to_numpy(), user))]

    return _per_user_columns(fixes, walk, f"{_uid(fixes)}, {_KEPT}", finish, named=True)


def _reach(z: list[complex], i: int, epsilon: float, step: int) -> list[int]:
    """Places j (going by step from i) whose direction from i passes all fixes between within epsilon: the wedge of i."""
    out, lo, hi, axis = [], -math.inf, math.inf, None
    end, a = len(z) if step > 0 else -1, z[i]
    for j in range(i + step, end, step):
        d = z[j] - a
        far = abs(d)
        if axis is None:
            ok, off = True, 0.0
        else:
            turned = d / axis
            off = math.atan2(turned.imag, turned.real) if far else 0.0
            ok = not far or lo <= off <= hi
        if ok:
            out.append(j)
        if far > epsilon:
            if axis is None:
                axis, off = d / far, 0.0
            half = math.asin(epsilon / far)
            lo, hi = max(lo, off - half), min(hi, off + half)
            if lo > hi:
                break
    return out


def simplify_chan_chin(fixes: DataFrame, epsilon_km: float = 0.001) -> DataFrame:
    """The fewest fixes whose pieces stay within epsilon_km: pieces in the wedges of both their ends, shortest path."""

    def keep(t, lat, lng):
        z, n = _planar(lat, lng).tolist(), len(t)
        back = [set(_reach(z, j, epsilon_km, -1)) for j in range(n)]
        before, todo = [-1] * n, deque([0])
        while todo and before[n - 1] < 0 < n - 1:
            i = todo.popleft()
            for j in _reach(z, i, epsilon_km, 1):
                if before[j] < 0 and i in back[j]:
                    before[j] = i
                    todo.append(j)
        out, at = np.zeros(n, bool), n - 1
        while at >= 0:
            out[at], at = True, before[at] if at else -1
        return out

    return _masked(fixes, keep)


def _feasible(z: np.ndarray, i: int, epsilon: float) -> list[int]:
    """Places j after i whose straight piece from i passes all fixes between within epsilon. The next ones go out first, so most
    pieces are left after a few fixes; no more than 1,000,000 distances are held at once."""
    ends, k, take = np.arange(i + 2, len(z)), i + 1, 4
    done = [i + 1] if i + 1 < len(z) else []
    while len(ends):
        take = max(1, min(take, 1_000_000 // len(ends)))
        between = np.arange(k, min(k + take, int(ends[-1])))
        p, d = z[between] - z[i], (z[ends] - z[i])[:, None]
        size = abs(d) ** 2
        along = np.where(size > 0, np.clip((p * d.conjugate()).real / np.where(size > 0, size, 1), 0, 1), 0.0)
        ends = ends[((np.abs(p - along * d) <= epsilon) | (between >= ends[:, None])).all(1)]
        k, take = k + len(between), take * 2
        done += ends[ends <= k].tolist()
        ends = ends[ends > k]
    return done


def simplify_imai_iri(fixes: DataFrame, epsilon_km: float = 0.001) -> DataFrame:
    """From each kept fix to the feasible one from which the path reaches farthest."""

    def keep(t, lat, lng):
        z, n, known = _planar(lat, lng), len(t), {}

        def fits(i):
            if i not in known:
                known[i] = _feasible(z, i, epsilon_km)
            return known[i]

        out, at = np.zeros(n, bool), 0
        out[[0, -1]] = True
        while at < n - 1:
            # The end, where it is feasible; else only fixes that are feasible from here are asked how far they reach.
            at = n - 1 if fits(at)[-1] == n - 1 else max(fits(at), key=lambda j: (fits(j)[-1] if j < n - 1 else j, j))
            out[at] = True
        return out

    return _masked(fixes, keep)


def triplegs(fixes: DataFrame, stop_radius_km: float = 0.2, minutes_for_a_stop: float = 20.0, no_data_for_minutes: float = 1e12) -> DataFrame:
    """Moves between stops: times bracketed by the neighbouring segments, km (the edge into a stop counts to the move), km/h."""

    def walk(part, t, lat, lng):
        found = _stays(t, lat, lng, minutes_for_a_stop, stop_radius_km, no_data_for_minutes, True)
        inside = _within(t, found)
        seg = np.r_[0, np.diff(inside.astype(int)) != 0].cumsum()
        first = np.flatnonzero(np.r_[True, np.diff(seg) > 0])
        last = np.r_[first[1:] - 1, len(t) - 1]
        opens = {round(s * 1000) for s, *_ in found}
        stop = np.array([round(t[i] * 1000) in opens for i in first])
        owner = seg[1:].copy()
        into = np.flatnonzero(np.diff(seg) > 0)
        owner[into] -= stop[seg[into + 1]]
        km = np.bincount(owner, _km(lat[:-1], lng[:-1], lat[1:], lng[1:]), len(first))
        s, e = np.r_[t[first[0]], t[last[:-1]]], np.r_[t[first[1:]], t[last[-1]]]
        hours = (e - s) / 3600
        got = pd.DataFrame({"uid": part["uid"].iloc[0], "tripleg_id": part["event_id"].to_numpy()[first], "started_at": _times(s), "finished_at": _times(e), "length_km": km, "speed_kmh": np.where(hours > 0, km / np.where(hours > 0, hours, 1), 0.0)})
        return got[~stop]

    return _per_user(fixes, walk, f"{_uid(fixes)}, tripleg_id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, length_km double, speed_kmh double")


def cluster(fixes: DataFrame, degrees: float = 0.002, min_samples: int = 1) -> DataFrame:
    """Each fix's cluster among its user's: touching grid cells of min_samples fixes or more, largest first; others are -1."""

    def walk(part, t, lat, lng):
        cell = np.column_stack([np.floor(lat / degrees), np.floor(lng / degrees)]).astype(np.int64)
        cells, of, n = np.unique(cell, axis=0, return_inverse=True, return_counts=True)
        of = of.ravel()
        at = {tuple(c): k for k, c in enumerate(cells.tolist()) if n[k] >= min_samples}
        label = np.full(len(cells), -1)
        for k in at.values():
            if label[k] < 0:
                todo, label[k] = [k], k
                while todo:
                    a, b = cells[todo.pop()]
                    for x in range(-1, 2):
                        for y in range(-1, 2):
                            m = at.get((a + x, b + y))
                            if m is not None and label[m] < 0:
                                label[m] = k
                                todo.append(m)
        mine = pd.Series(label[of])
        seen = mine[mine >= 0]
        order = pd.DataFrame({"n": seen.groupby(seen).size(), "first": seen.groupby(seen).apply(lambda g: g.index[0])}).sort_values(["n", "first"], ascending=[False, True]) if len(seen) else pd.DataFrame(index=[])
        rank = {k: r for r, k in enumerate(order.index)}
        return part[["uid", "event_id"]].assign(cluster=mine.map(rank).fillna(-1).astype("int64").to_numpy())

    return _per_user(fixes, walk, f"{_uid(fixes)}, event_id bigint, cluster bigint")


def user_locations(fixes: DataFrame, degrees: float = 0.002, min_samples: int = 1) -> DataFrame:
    """The clusters of each user with mean centre and number of fixes."""
    got = cluster(fixes, degrees, min_samples).where("cluster >= 0").join(fixes.select("uid", "event_id", "lat", "lng"), ["uid", "event_id"])
    return got.groupBy("uid", F.col("cluster").alias("location_id")).agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lng"), 6).alias("lng"), F.count("*").alias("n"))


def _pair_distance(method: str, epsilon_km: float):
    def dtw(d):
        row = np.cumsum(d[0])
        for i in range(1, len(d)):
            new, left = np.empty_like(row), np.inf
            up = np.minimum(row, np.r_[np.inf, row[:-1]])
            for j in range(len(row)):
                left = d[i, j] + min(up[j], left)
                new[j] = left
            row = new
        return row[-1]

    def frechet(d):
        row = np.maximum.accumulate(d[0])
        for i in range(1, len(d)):
            new, left = np.empty_like(row), np.inf
            up = np.minimum(row, np.r_[np.inf, row[:-1]])
            for j in range(len(row)):
                left = max(d[i, j], min(up[j], left))
                new[j] = left
            row = new
        return row[-1]

    def lcss(d):
        row = np.zeros(d.shape[1] + 1, int)
        for near in d <= epsilon_km:
            new = np.maximum(row[1:], np.where(near, row[:-1] + 1, 0))
            row = np.r_[0, np.maximum.accumulate(new)]
        return row[-1] / min(d.shape)

    return {"dtw": dtw, "frechet": frechet, "lcss": lcss, "hausdorff": lambda d: max(d.min(1).max(), d.min(0).max())}[method]


def trajectory_distance(fixes: DataFrame, pairs: DataFrame, method: str = "dtw", epsilon_km: float = 0.1) -> DataFrame:
    """Distance (km) of the sequences of two users, for each pair (a, b): dtw, frechet, hausdorff, or lcss, a likeness of 0 to 1.

    Users without fixes have none. A pair's two sequences meet in one task.
    """
    run = _pair_distance(method, epsilon_km)
    rows = fixes.where(valid(F.col("lat"), F.col("lng")) & F.col("datetime").isNotNull())
    lines = rows.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("datetime", "event_id", "lat", "lng"))).alias("p"))
    lines = lines.select("uid", F.transform("p", lambda x: x["lat"]).alias("lat"), F.transform("p", lambda x: x["lng"]).alias("lng"))
    both = pairs.join(lines.select(F.col("uid").alias("a"), F.col("lat").alias("alat"), F.col("lng").alias("alng")), "a").join(lines.select(F.col("uid").alias("b"), F.col("lat").alias("blat"), F.col("lng").alias("blng")), "b")

    @F.pandas_udf("double")
    def distance(alat: pd.Series, alng: pd.Series, blat: pd.Series, blng: pd.Series) -> pd.Series:
        return pd.Series([float(run(_km(np.asarray(p)[:, None], np.asarray(q)[:, None], np.asarray(r), np.asarray(s)))) for p, q, r, s in zip(alat, alng, blat, blng, strict=True)], dtype=float)

    return both.select("a", "b", distance("alat", "alng", "blat", "blng").alias("distance"))


def shape_signatures(fixes: DataFrame, depth: int = 4) -> DataFrame:
    """Chord over arc of each equal part (by number of fixes) of a user's line, at levels 1 to depth; 1 where there is no arc."""

    def walk(part, t, lat, lng):
        arc = np.r_[0.0, np.cumsum(_km(lat[:-1], lng[:-1], lat[1:], lng[1:]))]
        out = []
        for level in range(1, depth + 1):
            cut = np.linspace(0, len(t) - 1, level + 1).round().astype(int)
            a, b = cut[:-1], cut[1:]
            way = arc[b] - arc[a]
            out += np.where(way > 0, _km(lat[a], lng[a], lat[b], lng[b]) / np.where(way > 0, way, 1), 1.0).round(9).tolist()
        return pd.DataFrame({"uid": part["uid"].iloc[:1], "signature": [out]})

    return _per_user(fixes, walk, f"{_uid(fixes)}, signature array<double>")


def cluster_trajectory_shapes(fixes: DataFrame, depth: int = 4, epsilon: float = 0.05, min_cluster_size: int = 2) -> DataFrame:
    """uid, cluster: users whose lines have like shapes; -1 for those like too few others.

    Signatures within epsilon (Euclidean) are neighbours; those with min_cluster_size neighbours, themselves included, are
    cores; cores that are neighbours share a cluster, and others join that of their nearest core. Neighbours are met in
    cells of the two components that vary most over levels, so not all pairs are compared. Clusters are numbered by their
    least user.
    """
    signed = shape_signatures(fixes, depth).persist()
    wide = 1 if depth > 1 else 0  # the whole line, and the first half of it
    cell = lambda i: F.floor(F.col("signature")[i] / epsilon).cast("long")
    a = signed.select(F.col("uid").alias("a"), F.col("signature").alias("x"), F.explode(F.sequence(cell(0) - 1, cell(0) + 1)).alias("p"), cell(wide).alias("q0")).withColumn("q", F.explode(F.sequence(F.col("q0") - 1, F.col("q0") + 1))).drop("q0")
    b = signed.select(F.col("uid").alias("b"), F.col("signature").alias("y"), cell(0).alias("p"), cell(wide).alias("q"))
    far = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, d: s + d))
    near = a.join(b, ["p", "q"]).withColumn("d", far).where(F.col("d") <= epsilon).select("a", "b", "d").persist()
    cores = near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_cluster_size).select(F.col("a").alias("node"))
    links = near.join(cores.withColumnRenamed("node", "a"), "a").join(cores.withColumnRenamed("node", "b"), "b").where("a < b").select("a", "b")
    root = components(cores, links)
    border = near.join(root.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min_by("root", F.struct("d", "root")).alias("reached"))
    got = signed.select("uid").join(root.withColumnRenamed("node", "uid"), "uid", "left").join(border.withColumnRenamed("a", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "reached"))
    # One row a cluster is numbered, not one a user.
    numbered = root.select("root").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("root")) - 1)
    return got.join(F.broadcast(numbered), "root", "left").select("uid", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def cluster_trajectory_shapes_from_segments(segments: DataFrame, depth: int = 4, epsilon: float = 0.05, min_cluster_size: int = 2) -> DataFrame:
    """uid, segment_id, cluster: the same for the lines of fixes(uid, segment_id, datetime, event_id, lat, lng)."""
    key = F.concat_ws("/", F.col("uid").cast("string"), F.col("segment_id").cast("string"))
    lines = segments.withColumn("line", key)
    found = cluster_trajectory_shapes(lines.drop("uid").withColumnRenamed("line", "uid"), depth, epsilon, min_cluster_size)
    return lines.select("uid", "segment_id", "line").distinct().join(found.withColumnRenamed("uid", "line"), "line").select("uid", "segment_id", "cluster")


def speeds(fixes: DataFrame) -> DataFrame:
    """km/h into each fix from the one before; 0 for the first and where no time passes."""
    return _per_user(fixes, lambda part, t, lat, lng: part[["uid", "event_id"]].assign(speed_kmh=_kmh(t, lat, lng)), f"{_uid(fixes)}, event_id bigint, speed_kmh double")
