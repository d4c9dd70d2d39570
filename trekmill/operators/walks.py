"""Further walks over one user's fixes: stays, segments, simplification, smoothing, sequence entropies, tours.

Rows are prepared as in kernels: valid coordinates with a time, in (datetime, event_id) order,
one Arrow-fed call per user. A user's fixes are held in memory by one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine, valid
from .kernels import _km, _per_user, _per_user_columns, _per_user_masked, _starts

_KEPT = "datetime timestamp_ntz, event_id bigint, lat double, lng double"


def _uid(df: DataFrame) -> str:
    return f"uid {df.schema['uid'].dataType.simpleString()}"


def _kmh(t, lat, lng) -> np.ndarray:
    """Speed into each fix from the one before; 0 for the first and where no time passes."""
    dt, km = np.diff(t), _km(lat[:-1], lng[:-1], lat[1:], lng[1:])
    return np.r_[0.0, np.where(dt > 0, km / np.where(dt > 0, dt, 1) * 3600, 0.0)]


def _planar(lat, lng) -> np.ndarray:
    """Local kilometres as complex numbers."""
    return EARTH_KM * (np.radians(lng) * np.cos(np.radians(lat.mean())) + 1j * np.radians(lat))


def _from_segment(p, a, b) -> np.ndarray:
    """Distances of points p to the straight piece from a to b."""
    d = b - a
    along = np.clip(((p - a) * d.conjugate()).real / abs(d) ** 2, 0, 1) if d else 0.0
    return np.abs(p - a - along * d)


def _masked(fixes: DataFrame, keep) -> DataFrame:
    """The fixes that keep(t, lat, lng) marks."""
    return _per_user_masked(fixes, keep, f"{_uid(fixes)}, {_KEPT}")


def _speeds(fixes: DataFrame) -> DataFrame:
    """The usable fixes with us (microseconds) and v: km/h from the fix before, 0 for the first and where no time passes."""
    line = Window.partitionBy("uid").orderBy("datetime", "event_id")
    rows = fixes.where(valid(F.col("lat"), F.col("lng")) & F.col("datetime").isNotNull()).select("uid", "datetime", "event_id", "lat", "lng")
    rows = rows.withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', datetime)"))
    dt = (F.col("us") - F.lag("us").over(line)) / 3.6e9
    km = haversine(F.lag("lat").over(line), F.lag("lng").over(line), F.col("lat"), F.col("lng"))
    return rows.withColumn("v", F.when(dt > 0, km / dt).otherwise(0.0))


def filter_hampel(fixes: DataFrame, window_size: int = 5, n_sigma: float = 3.0) -> DataFrame:
    """Drops fixes whose speed is n_sigma scaled median deviations from the median of a centred window; the ends stay."""
    half = window_size // 2
    line = Window.partitionBy("uid").orderBy("datetime", "event_id")
    rows = _speeds(fixes).withColumn("near", F.array_sort(F.collect_list("v").over(line.rowsBetween(-half, half))))
    mid = F.element_at("near", half + 1)
    spread = F.element_at(F.array_sort(F.transform("near", lambda x: F.abs(x - F.col("mid")))), half + 1)
    whole = F.size("near") == 2 * half + 1
    kept = rows.withColumn("mid", F.when(whole, mid)).withColumn("spread", F.when(whole, spread)).where(F.coalesce(F.abs(F.col("v") - F.col("mid")) <= n_sigma * 1.4826 * F.col("spread"), F.lit(True)))
    return kept.select("uid", "datetime", "event_id", "lat", "lng")


def filter_smart_greedy(fixes: DataFrame, max_speed_kmh: float = 100.0) -> DataFrame:
    """Keeps the longest chain of consistent fixes. A fix extends the longest chain it is consistent with
    (ties: the earliest), ends the others that it is consistent with, or starts its own; of equal chains the latest."""

    def keep(t, lat, lng):
        size, before, open_ = np.ones(len(t), int), np.full(len(t), -1), np.zeros(0, int)
        for i in range(len(t)):
            dt = t[i] - t[open_]
            fits = (dt > 0) & (_km(lat[open_], lng[open_], lat[i], lng[i]) * 3600 <= max_speed_kmh * dt)
            if fits.any():
                before[i] = open_[fits][size[open_[fits]].argmax()]
                size[i] += size[before[i]]
            open_ = np.append(open_[~fits], i)
        out, at = np.zeros(len(t), bool), max(open_, key=lambda k: (size[k], k))
        while at >= 0:
            out[at], at = True, before[at]
        return out

    return _masked(fixes, keep)


def _split(far):
    """Keep-mask by splitting at the farthest point: far(i, j) gives distances of the points between i and j."""

    def keep(n: int, epsilon: float) -> np.ndarray:
        out, todo = np.zeros(n, bool), [(0, n - 1)]
        out[[0, -1]] = True
        while todo:
            i, j = todo.pop()
            if j - i < 2:
                continue
            d = far(i, j)
            k = int(d.argmax())
            if d[k] > epsilon:
                out[i + 1 + k] = True
                todo += [(i, i + 1 + k), (i + 1 + k, j)]
        return out

    return keep


def simplify_douglas_peucker(fixes: DataFrame, epsilon_km: float = 0.001) -> DataFrame:
    """Keeps a fix where the line between kept ones would pass it by more than epsilon_km."""

    def keep(t, lat, lng):
        z = _planar(lat, lng)
        return _split(lambda i, j: _from_segment(z[i + 1 : j], z[i], z[j]))(len(t), epsilon_km)

    return _masked(fixes, keep)


def simplify_top_down_time_ratio(fixes: DataFrame, epsilon_km: float = 0.001) -> DataFrame:
    """The same against the place on the line at the fix's own time."""

    def keep(t, lat, lng):
        z = _planar(lat, lng)

        def far(i, j):
            share = (t[i + 1 : j] - t[i]) / (t[j] - t[i]) if t[j] != t[i] else 0.0
            return np.abs(z[i + 1 : j] - z[i] - share * (z[j] - z[i]))

        return _split(far)(len(t), epsilon_km)

    return _masked(fixes, keep)


def simplify_max_distance(fixes: DataFrame, epsilon_km: float = 0.001) -> DataFrame:
    """Opens a new piece, and keeps the fix before, once a fix since the anchor is epsilon_km off the line from the anchor to this one."""

    def keep(t, lat, lng):
        z, out, anchor, since = _planar(lat, lng), np.zeros(len(t), bool), 0, 1
        for i in range(1, len(t)):
            if i > since and (_from_segment(z[since:i], z[anchor], z[i]) > epsilon_km).any():
                out[i - 1], anchor, since = True, i, i
        out[[0, -1]] = True
        return out

    return _masked(fixes, keep)


def _stays(t, lat, lng, minutes, radius, no_data, include_last, min_speed_kmh=None) -> list[tuple]:
    """(first, end, members' median lat, lng) of each stop; rows are the anchor up to the row that closes it.

    With min_speed_kmh a stop ends at its last row that is slower, seen from the anchor, and the members before that one stay.
    """
    new = np.r_[True, (np.diff(lat) != 0) | (np.diff(lng) != 0) | (np.diff(t) != 0)]
    t, lat, lng = t[new], lat[new], lng[new]
    out, anchor, ahead, steps = [], 0, [], (np.diff(t) > no_data * 60).tolist()
    leaves = (_km(lat[:-1], lng[:-1], lat[1:], lng[1:]) >= radius).tolist()
    for i in range(1, len(t)):
        if steps[i - 1]:
            anchor, ahead = i, []
            continue
        last = include_last and i == len(t) - 1
        if i == anchor + 1:
            ahead = [leaves[anchor]]
        elif not ahead:  # distances from an anchor, some at a time
            ahead = (_km(lat[anchor], lng[anchor], lat[i : i + 16], lng[i : i + 16]) >= radius).tolist()[::-1]
        if ahead.pop() or last:
            ahead = []
            end, stop = i, i
            if min_speed_kmh is not None:
                dt = t[anchor + 1 : i + 1] - t[anchor]
                km = _km(lat[anchor], lng[anchor], lat[anchor + 1 : i + 1], lng[anchor + 1 : i + 1])
                slow = np.flatnonzero(np.where(dt > 0, km / np.where(dt > 0, dt, 1) * 3600, 0.0) < min_speed_kmh)
                if len(slow) and anchor + 1 + slow[-1] < i:
                    end = anchor + 1 + int(slow[-1])
                    stop = end - 1
            if stop > anchor and t[end] - t[anchor] >= minutes * 60:
                one = stop == anchor + 1
                out.append((t[anchor], t[end], lat[anchor] if one else np.median(lat[anchor:stop]), lng[anchor] if one else np.median(lng[anchor:stop])))
            anchor = i
    return out


def _within(t: np.ndarray, stays: list[tuple]) -> np.ndarray:
    """Which of the times, in order, are within stays, ends included."""
    change = np.zeros(len(t) + 1, int)
    if stays:
        np.add.at(change, np.searchsorted(t, [x[0] for x in stays], "left"), 1)
        np.add.at(change, np.searchsorted(t, [x[1] for x in stays], "right"), -1)
    return np.cumsum(change)[:-1] > 0


def stay_locations(fixes: DataFrame, minutes_for_a_stop: float = 20.0, spatial_radius_km: float = 0.2, no_data_for_minutes: float = 1e12, include_last: bool = True, min_speed_kmh: float | None = None) -> DataFrame:
    """Stops: started_at, finished_at and median coordinates."""

    def walk(t, lat, lng):
        found = _stays(t, lat, lng, minutes_for_a_stop, spatial_radius_km, no_data_for_minutes, include_last, min_speed_kmh)
        s, e, a, b = zip(*found, strict=True) if found else ((), (), (), ())
        return {"s": np.array(s, float), "e": np.array(e, float), "lat": np.array(a, float), "lng": np.array(b, float), "n": [len(s)]}

    def finish(part, got):
        times = [pd.to_datetime(np.rint(got[x] * 1e6).astype("int64"), unit="us") for x in "se"]
        return pd.DataFrame({"uid": part["uid"].iloc[np.repeat(_starts(part["uid"]), got["n"])].to_numpy(), "started_at": times[0], "finished_at": times[1], "lat": got["lat"], "lng": got["lng"]})

    return _per_user_columns(fixes, walk, f"{_uid(fixes)}, started_at timestamp_ntz, finished_at timestamp_ntz, lat double, lng double", finish)


def _segments(fixes: DataFrame, number) -> DataFrame:
    schema = f"{_uid(fixes)}, event_id bigint, segment_id bigint"
    return _per_user_columns(fixes, lambda t, lat, lng: {"segment_id": np.asarray(number(t, lat, lng), np.int64)}, schema, lambda part, got: part[["uid", "event_id"]].assign(**got))


def segment_angle_change(fixes: DataFrame, min_angle: float = 45.0, min_speed_kmh: float = 0.0) -> DataFrame:
    """New segment where the bearing is min_angle off that of the segment's start, at min_speed_kmh or more."""

    def number(t, lat, lng):
        a, b, d = np.radians(lat[:-1]), np.radians(lat[1:]), np.radians(np.diff(lng))
        turn = np.degrees(np.arctan2(np.sin(d) * np.cos(b), np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(d)))
        v, out = _kmh(t, lat, lng), np.zeros(len(t), int)
        first = turn[0] if len(turn) else 0.0
        for i in range(1, len(t)):
            off = abs((turn[i - 1] - first + 180) % 360 - 180)
            out[i] = out[i - 1]
            if v[i] >= min_speed_kmh and off >= min_angle:
                first, out[i] = turn[i - 1], out[i - 1] + 1
        return out

    return _segments(fixes, number)


def segment_speed(fixes: DataFrame, speed_kmh: float = 0.0, max_speed_kmh: float = float("inf"), duration_s: float = 300.0) -> DataFrame:
    """Runs outside the speed bounds that last duration_s are segments of their own. The first fix starts no run."""
    line = Window.partitionBy("uid").orderBy("datetime", "event_id")
    rows = _speeds(fixes).withColumn("k", F.row_number().over(line)).withColumn("still", (F.col("k") > 1) & ((F.col("v") < speed_kmh) | (F.col("v") > max_speed_kmh)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("still") == F.lag("still").over(line), 0).otherwise(1)).over(line))
    run = Window.partitionBy("uid", "run")
    rows = rows.withColumn("long", F.col("still") & (F.max("us").over(run) - F.min("us").over(run) >= duration_s * 1e6))
    new = (F.col("k") > 1) & (F.col("run") != F.lag("run").over(line)) & (F.col("long") | F.lag("long").over(line))
    return rows.withColumn("new", F.when(new, 1).otherwise(0)).select("uid", "event_id", F.sum("new").over(line).cast("long").alias("segment_id"))


def segment_stop(fixes: DataFrame, stop_radius_km: float = 0.2, minutes_for_a_stop: float = 20.0, no_data_for_minutes: float = 1e12) -> DataFrame:
    """Segments in turn inside and outside stops."""

    def number(t, lat, lng):
        inside = _within(t, _stays(t, lat, lng, minutes_for_a_stop, stop_radius_km, no_data_for_minutes, True))
        return np.r_[0, np.diff(inside.astype(int)) != 0].cumsum()

    return _segments(fixes, number)


def smooth_kalman(fixes: DataFrame, process_noise_std_km: float = 0.05, measurement_noise_std_km: float = 0.1) -> DataFrame:
    """Constant-velocity filter and backward smoother in local kilometres; one fix stays as it is."""
    q, r = process_noise_std_km**2, measurement_noise_std_km**2

    def walk(t, lat, lng):
        if len(t) < 2:
            return {"lat": lat, "lng": lng}
        scale = EARTH_KM * np.cos(np.radians(lat.mean())) * np.pi / 180, EARTH_KM * np.pi / 180
        seen = np.column_stack([lng * scale[0], lat * scale[1]])
        steps = np.maximum(np.diff(t), 1e-6)
        # States (place and speed, for both axes) and covariances (symmetric two by two) as plain numbers.
        (x0, x1), (v0, v1), (a, b, c) = seen[0].tolist(), (0.0, 0.0), (r, 0.0, 1e6)
        states, ahead = [(x0, x1, v0, v1, a, b, c)], []
        for (z0, z1), dt in zip(seen[1:].tolist(), steps.tolist(), strict=True):
            g0, g1 = x0 + dt * v0, x1 + dt * v1
            sa, sb, sc = a + dt * b + dt * (b + dt * c) + q * dt**3 / 3, b + dt * c + q * dt**2 / 2, c + q * dt
            ka, kb = sa / (sa + r), sb / (sa + r)
            ahead.append((dt, g0, g1, v0, v1, sa, sb, sc))
            x0, x1, v0, v1 = g0 + ka * (z0 - g0), g1 + ka * (z1 - g1), v0 + kb * (z0 - g0), v1 + kb * (z1 - g1)
            a, b, c = sa - ka * sa, sb - ka * sb, sc - kb * sb
            states.append((x0, x1, v0, v1, a, b, c))
        at = np.empty((len(t), 2))
        at[-1] = x0, x1
        for i in range(len(ahead) - 1, -1, -1):
            dt, g0, g1, w0, w1, sa, sb, sc = ahead[i]
            y0, y1, u0, u1, a, b, c = states[i]
            d = sa * sc - sb * sb
            ha, hb = a + dt * b, b + dt * c  # of the covariance and the step: the gain is that over the spread
            k00, k01, k10, k11 = (ha * sc - b * sb) / d, (b * sa - ha * sb) / d, (hb * sc - c * sb) / d, (c * sa - hb * sb) / d
            e0, e1, f0, f1 = x0 - g0, x1 - g1, v0 - w0, v1 - w1
            x0, x1, v0, v1 = y0 + k00 * e0 + k01 * f0, y1 + k00 * e1 + k01 * f1, u0 + k10 * e0 + k11 * f0, u1 + k10 * e1 + k11 * f1
            at[i] = x0, x1
        return {"lat": at[:, 1] / scale[1], "lng": at[:, 0] / scale[0]}

    return _per_user_columns(fixes, walk, f"{_uid(fixes)}, {_KEPT}", lambda part, got: part.assign(**got))


def _kontoyiannis(s: np.ndarray) -> float:
    """n log2 n over the summed lengths of the longest earlier matches."""
    n = len(s)
    if n < 2:
        return 0.0
    most, run = np.ones(n), np.ones(n)
    for i in range(1, n - 1):
        run[i + 1 :] = np.where(s[i : n - 1] == s[i - 1], run[i : n - 1] + 1, 1)
        np.maximum(most[i + 1 :], run[i + 1 :], out=most[i + 1 :])
    return float(n * np.log2(n) / most.sum())


def real_entropy(fixes: DataFrame) -> DataFrame:
    """Entropy of each user's sequence of coordinates by the lengths of its matches; 0 for one fix. Quadratic in a user's fixes."""

    def walk(part, t, lat, lng):
        codes = pd.factorize(pd.MultiIndex.from_arrays([lat, lng]))[0]
        return pd.DataFrame({"uid": part["uid"].iloc[:1], "real_entropy": [round(_kontoyiannis(codes), 6)]})

    return _per_user(fixes, walk, f"{_uid(fixes)}, real_entropy double")


def _fano(h: float, n: int) -> float:
    """Largest predictability that entropy h over n places allows."""
    if n < 2:
        return 1.0
    top = np.log2(n)
    h = min(max(h, 0.0), top)
    if h < 1e-12 or top - h < 1e-12:
        return 1.0 if h < 1e-12 else 1 / n
    lo, hi = 1 / n, 1.0
    while hi - lo > 1e-8:
        p = (lo + hi) / 2
        spare = (-p * np.log2(p) - (1 - p) * np.log2(1 - p) if p < 1 else 0.0) + (1 - p) * np.log2(n - 1) - h
        lo, hi = (p, hi) if spare > 0 else (lo, p)
    return (lo + hi) / 2


def trajectory_predictability(fixes: DataFrame) -> DataFrame:
    """Entropy of a user's sequence of coordinates, its bound of predictability, places and steps. Quadratic in a user's fixes."""

    def walk(part, t, lat, lng):
        codes = pd.factorize(pd.MultiIndex.from_arrays([lat, lng]))[0]
        h, n = _kontoyiannis(codes), int(codes.max()) + 1
        return pd.DataFrame({"uid": part["uid"].iloc[:1], "real_entropy": [round(h, 9)], "predictability": [round(_fano(h, n), 6)], "n_unique": [n], "n_steps": [len(codes)]})

    return _per_user(fixes, walk, f"{_uid(fixes)}, real_entropy double, predictability double, n_unique bigint, n_steps bigint")


def tours(trips: DataFrame) -> DataFrame:
    """First and last trip of each tour, and the journey (its trips in order): trips(uid, trip_id, origin, destination) in trip_id order; the first later (or same)
    trip that ends where a trip starts closes its tour, and the search goes on after it. Null origins start none."""

    def walk(part):
        part = part.sort_values("trip_id", kind="stable")
        start, end, ids = (part[c].tolist() for c in ("origin", "destination", "trip_id"))
        out, j = [], 0
        while j < len(ids):
            k = next((k for k in range(j, len(ids)) if end[k] == start[j]), None) if start[j] is not None and start[j] == start[j] else None
            if k is not None:
                out.append((part["uid"].iloc[0], ids[j], ids[k], k - j + 1, ids[j : k + 1]))
                j = k
            j += 1
        return pd.DataFrame(out, columns=["uid", "first_trip", "last_trip", "n_trips", "journey"])

    return trips.select("uid", "trip_id", "origin", "destination").groupBy("uid").applyInPandas(walk, f"{_uid(trips)}, first_trip bigint, last_trip bigint, n_trips bigint, journey array<bigint>")
