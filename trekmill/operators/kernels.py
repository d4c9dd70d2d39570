"""Order-dependent cleaning of one user's fixes: what no fixed window frame expresses.

Each walks a user's fixes in (datetime, event_id) order in one Arrow-fed call per user;
rows with a missing or non-finite coordinate or no time are left out first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, valid


def _km(lat1, lng1, lat2, lng2):
    lat1, lng1, lat2, lng2 = (np.radians(x) for x in (lat1, lng1, lat2, lng2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lng2 - lng1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def _per_user(fixes: DataFrame, walk, schema: str) -> DataFrame:
    """walk(part, t, lat, lng) over each user's rows; the rows of a task are put in order and come in batches of many users."""
    rows = fixes.where(valid(F.col("lat"), F.col("lng")) & F.col("datetime").isNotNull()).select("uid", "datetime", "event_id", "lat", "lng")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, cuts in _whole_users(parts):
            seconds = part["datetime"].to_numpy().astype("datetime64[us]").astype(np.int64) / 1e6
            lat, lng = part["lat"].to_numpy(), part["lng"].to_numpy()
            out = [walk(part.iloc[a:b].reset_index(drop=True), seconds[a:b], lat[a:b], lng[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if out:
                yield pd.concat(out, ignore_index=True)

    return _by_user(rows).mapInPandas(run, schema)


def _per_user_masked(fixes: DataFrame, keep, schema: str) -> DataFrame:
    """The rows that keep(t, lat, lng) marks among a user's; a batch is cut to them once, and no user has a table of its own."""
    return _per_user_columns(fixes, lambda t, lat, lng: {"kept": keep(t, lat, lng)}, schema, lambda part, got: part[got["kept"]])


def _per_user_columns(fixes: DataFrame, walk, schema: str, finish, named: bool = False) -> DataFrame:
    """finish(part, columns): a batch of users, and the arrays that walk(t, lat, lng), or walk(t, lat, lng, uid), gives for each user's rows put in a line."""
    rows = fixes.where(valid(F.col("lat"), F.col("lng")) & F.col("datetime").isNotNull()).select("uid", "datetime", "event_id", "lat", "lng")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, cuts in _whole_users(parts):
            seconds = part["datetime"].to_numpy().astype("datetime64[us]").astype(np.int64) / 1e6
            lat, lng = part["lat"].to_numpy(), part["lng"].to_numpy()
            uid = part["uid"]
            got = [walk(seconds[a:b], lat[a:b], lng[a:b], *([uid.iloc[a]] if named else [])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if got:
                yield finish(part, {k: np.concatenate([g[k] for g in got]) for k in got[0]})

    return _by_user(rows).mapInPandas(run, schema)


def _by_user(rows: DataFrame) -> DataFrame:
    return rows.repartition("uid").sortWithinPartitions("uid", "datetime", F.col("event_id").asc_nulls_last())


def _whole_users(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows in the order of users, cut so that each user is in one, with the places where users begin and the end."""
    held = []
    for part in parts:
        if not len(part):
            continue
        new = _starts(part["uid"])
        if held and not _same(held[-1]["uid"].iloc[-1], part["uid"].iloc[0]):
            yield _with_cuts(held)
            held = []
        if len(new) > 1:
            yield _with_cuts([*held, part.iloc[: new[-1]]])
            held = [part.iloc[new[-1] :]]
        else:
            held.append(part)
    if held:
        yield _with_cuts(held)


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def _starts(uid: pd.Series) -> np.ndarray:
    codes = pd.factorize(uid, use_na_sentinel=False)[0]
    return np.flatnonzero(np.r_[True, np.diff(codes) != 0])


def _with_cuts(held: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
    part = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
    return part, np.r_[_starts(part["uid"]), len(part)]


def filter_speed(fixes: DataFrame, max_speed_kmh: float = 500.0) -> DataFrame:
    """Drops a fix that no time, or too much speed, separates from the last kept one. Keeps the first."""
    kind = fixes.schema["uid"].dataType.simpleString()

    def keep(t, lat, lng):
        out, step, at, j = np.zeros(len(t), bool), _km(lat[:-1], lng[:-1], lat[1:], lng[1:]).tolist(), t.tolist(), 0
        out[0] = True
        for i in range(1, len(t)):
            dt = at[i] - at[j]
            if dt > 0 and (step[j] if j == i - 1 else _km(lat[j], lng[j], lat[i], lng[i])) / dt * 3600 <= max_speed_kmh:
                out[i], j = True, i
        return out

    return _per_user_masked(fixes, keep, f"uid {kind}, datetime timestamp_ntz, event_id bigint, lat double, lng double")


def compress(fixes: DataFrame, spatial_radius_km: float = 0.2) -> DataFrame:
    """Runs of fixes within the radius of their first one become one row: its time, median coordinates."""
    kind = fixes.schema["uid"].dataType.simpleString()

    def walk(part, t, lat, lng):
        group, anchor, g = np.zeros(len(part), int), 0, 0
        for i in range(1, len(part)):
            if _km(lat[anchor], lng[anchor], lat[i], lng[i]) > spatial_radius_km:
                anchor, g = i, g + 1
            group[i] = g
        return part.groupby(group).agg({"uid": "first", "datetime": "first", "lat": "median", "lng": "median"})

    return _per_user(fixes, walk, f"uid {kind}, datetime timestamp_ntz, lat double, lng double")


def simplify_min_distance(fixes: DataFrame, min_distance_km: float = 0.01) -> DataFrame:
    """Keeps a fix at least so far from the last kept one, and the last fix."""
    kind = fixes.schema["uid"].dataType.simpleString()

    def walk(part, t, lat, lng):
        kept = [0]
        for i in range(1, len(part)):
            if i == len(part) - 1 or _km(lat[kept[-1]], lng[kept[-1]], lat[i], lng[i]) >= min_distance_km:
                kept.append(i)
        return part.iloc[kept]

    return _per_user(fixes, walk, f"uid {kind}, datetime timestamp_ntz, event_id bigint, lat double, lng double")


def simplify_min_time(fixes: DataFrame, min_time_delta_s: float = 60.0) -> DataFrame:
    """Keeps a fix at least so many seconds after the last kept one, and the last fix."""
    kind = fixes.schema["uid"].dataType.simpleString()

    def walk(part, t, lat, lng):
        kept = [0]
        for i in range(1, len(part)):
            if i == len(part) - 1 or t[i] - t[kept[-1]] >= min_time_delta_s:
                kept.append(i)
        return part.iloc[kept]

    return _per_user(fixes, walk, f"uid {kind}, datetime timestamp_ntz, event_id bigint, lat double, lng double")
