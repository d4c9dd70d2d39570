"""Walks over batches of many users: the same rows as a walk a user, at a batch's ends as well."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from trekmill.operators import kernels, motion, walks


def fixes(spark, users=30, seed=1):
    r = random.Random(seed)
    rows = [(f"u{u}" if u else None, float(60 * k + r.randrange(50)), k + 100 * u, 39.9 + r.random() / 50, 116.3 + r.random() / 50) for u in range(users) for k in range(r.randrange(1, 40))]
    rows += [("u1", 5e4, None, 39.9, 116.3), ("u2", 5e4, 7, math.nan, 116.3)]
    df = pd.DataFrame(rows, columns=["uid", "t", "event_id", "lat", "lng"]).astype({"event_id": "Int64"})
    r.shuffle(rows)
    return spark.createDataFrame(rows, "uid string, t double, event_id long, lat double, lng double").selectExpr("uid", "CAST(timestamp_seconds(t) AS TIMESTAMP_NTZ) AS datetime", "event_id", "lat", "lng"), df


def test_users_are_whole_in_small_batches(spark):
    seen, df = fixes(spark)
    usable = df[df["lat"].notna()]
    plan = kernels.filter_speed(seen)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan  # no table a user
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got.append([sorted(map(str, f(seen).collect())) for f in (kernels.filter_speed, walks.segment_stop, walks.stay_locations, walks.smooth_kalman, motion.interpolate, motion.shape_signatures, lambda f: motion.simplify_imai_iri(f, 0.5))])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1] and len(got[0][1]) == len(usable) and len(got[0][5]) == 30


@pytest.mark.parametrize("seed", range(5))
def test_feasible_pieces(seed):
    rng = np.random.default_rng(seed)
    z = np.cumsum(rng.normal(0, 0.4, 60) + 1j * rng.normal(0, 0.4, 60))
    z[7] = z[3]
    for i in range(60):
        want = [j for j in range(i + 1, 60) if j == i + 1 or (walks._from_segment(z[i + 1 : j], z[i], z[j]) <= 1.0).all()]
        assert motion._feasible(z, i, 1.0) == want


def test_kalman_by_matrices(spark):
    seen, df = fixes(spark, users=3, seed=4)
    got = {r["event_id"]: (r["lat"], r["lng"]) for r in walks.smooth_kalman(seen.where("uid = 'u2'")).collect()}
    part = df[(df["uid"] == "u2") & df["lat"].notna()].sort_values("t")
    t, q, r = part["t"].to_numpy(), 0.05**2, 0.1**2
    scale = 6371.0088 * np.pi / 180 * np.cos(np.radians(part["lat"].mean())), 6371.0088 * np.pi / 180
    seen_at = np.column_stack([part["lng"] * scale[0], part["lat"] * scale[1]])
    x, p, xs, ps, ahead = np.vstack([seen_at[0], [0, 0]]), np.diag([r, 1e6]), [], [], []
    xs, ps = [x], [p]
    for z, dt in zip(seen_at[1:], np.diff(t), strict=True):
        f = np.array([[1, dt], [0, 1]])
        guess, spread = f @ x, f @ p @ f.T + q * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
        gain = spread[:, :1] / (spread[0, 0] + r)
        x, p = guess + gain * (z - guess[0]), spread - gain @ spread[:1]
        xs, ps, ahead = [*xs, x], [*ps, p], [*ahead, (f, guess, spread)]
    for i in range(len(ahead) - 1, -1, -1):
        f, guess, spread = ahead[i]
        xs[i] = xs[i] + ps[i] @ f.T @ np.linalg.solve(spread, xs[i + 1] - guess)
    assert len(got) == len(part)
    for e, x in zip(part["event_id"], xs, strict=True):
        assert got[e] == (pytest.approx(x[0, 1] / scale[1], abs=1e-9), pytest.approx(x[0, 0] / scale[0], abs=1e-9))
