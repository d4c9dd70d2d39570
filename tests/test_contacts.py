"""Contacts by blocks of people against the joins by quarters of an hour and brute force."""

import datetime as dt
import random

import pytest

from trekmill.operators import contacts, sequence, social
from trekmill.plans import registry

T0 = dt.datetime(2024, 1, 1)


def visits(spark, n=60, rows=400, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(rows):
        s = T0 + dt.timedelta(minutes=r.randrange(3 * 1440), seconds=r.randrange(60))
        out.append((f"u{r.randrange(n)}", r.choice([1, 2, 3, None]), "x", s, s + dt.timedelta(minutes=r.choice([-5, 0, 4, 5, 30, 200, 1500]))))
    return spark.createDataFrame(out, "uid string, location_id int, purpose string, started_at timestamp_ntz, finished_at timestamp_ntz")


def shuffled(df):
    """The keys by which a plan deals rows."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]


def blocks(monkeypatch, size=7):
    monkeypatch.setattr(contacts, "BLOCK", size)


def test_contacts_of_blocks(spark, monkeypatch):
    blocks(monkeypatch)
    seen = visits(spark)
    got, want = ([tuple(r) for r in f(seen).collect()] for f in (contacts.daily_contacts, sequence.temporal_contacts))
    assert len(want) > 500 and sorted(got) == sorted(want)
    assert contacts.daily_contacts(seen.where("false")).count() == 0
    # No pair of people is dealt again once it is found.
    assert not [x for x in shuffled(registry.QUERIES["temporal_contacts"](spark, "/root/testdata/sf0.001")) if "u#" in x]


def test_counts_of_blocks(spark, monkeypatch):
    blocks(monkeypatch)
    for minutes in (5, 0, 30):
        got, want = (sorted(tuple(r) for r in f(visits(spark, seed=2), minutes=minutes).collect()) for f in (contacts.contact_counts, sequence.contact_network))
        assert want and got == want
    assert contacts.contact_counts(visits(spark).where("false")).count() == 0
    assert not [x for x in shuffled(registry.QUERIES["contact_network"](spark, "/root/testdata/sf0.001")) if "u#" in x]


def test_graphs_of_blocks(spark, monkeypatch):
    blocks(monkeypatch, 9)
    seen = visits(spark, n=25, rows=120, seed=3)
    rows = [tuple(r) for r in contacts.daily_contacts(seen).collect()]
    near = {}
    for _, u, v in rows:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    share = {u: sum(len(near[v] & n) for v in n) / (len(n) * (len(n) - 1)) if len(n) > 1 else 0.0 for u, n in near.items()}
    assert {r["uid"]: r["clustering"] for r in social.clustering_of_stays(seen).collect()} == {u: pytest.approx(x, abs=1e-6) for u, x in share.items()}
    mean = pytest.approx(sum(share.values()) / len(share), abs=1e-6)
    table = spark.createDataFrame(rows, "day long, u string, v string")
    assert social.mean_clustering_of_stays(seen).first()[0] == mean and social.mean_clustering(table).first()[0] == mean
    last = max(d for d, *_ in rows)
    assert {r["day"]: r["clustering"] for r in social.clustering_by_day(table).collect()}[last] == mean
    days = last - min(d for d, *_ in rows) + 1
    want = {(u, v): (pytest.approx(sum((u, v) == r[1:] for r in rows) / days), pytest.approx(len(near[u] & near[v]) / len(near[u] | near[v]))) for _, u, v in rows}
    two = social.persistence_and_overlap(table.crossJoin(spark.range(2).withColumnRenamed("id", "replica")), ["replica"])
    assert {(r["u"], r["v"]): (r["persistence"], r["overlap"]) for r in social.persistence_and_overlap(table).collect()} == want
    assert {(r["u"], r["v"]): (r["persistence"], r["overlap"]) for r in two.where("replica = 1").collect()} == want and two.count() == 2 * len(want)
    assert {(r["u"], r["v"]): r["persistence"] for r in social.recast(seen, replicates=1).collect()} == {k: x for k, (x, _) in want.items()}
    # Wedges are never listed: no join of edges with edges by one end.
    for name in ("mean_clustering", "clustering_coefficients", "topological_overlap"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [b#" not in plan and "FlatMapGroupsInArrow" in plan


def test_random_stubs_go_by_sparks_hash(spark):
    got = spark.range(50).selectExpr("xxhash64(id) AS h", "xxhash64(id, 0) AS a", "xxhash64(id, 1) AS b").toPandas()
    assert (social._with_end(got["h"].to_numpy(), 0) == got["a"]).all() and (social._with_end(got["h"].to_numpy(), 1) == got["b"]).all()


def test_combinations_and_profiles_are_dealt_by_user(spark):
    """Combinations are told apart where they are made, and slots stay with their users: only what crosses users is dealt again."""
    from trekmill.operators import attacks, visits as visit_operators

    seen = visits(spark, n=5, rows=40)
    keys = shuffled(attacks.assess_risk(seen, 2, "location_time"))
    assert not [x for x in keys if "uid#" in x and "known#" in x]
    assert not [x for x in shuffled(visit_operators.intermittency(seen)) if "slot#" in x or "run#" in x]
