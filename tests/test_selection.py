"""Quantiles by refined counting: any number of steps, ties, weights, skew and odd rows give the sorted list's numbers."""

import math
import random

import pytest

from fleetpulse.operators import ranking as RK

PROBS = [0.0, 0.3, 0.5, 0.95, 0.995, 1.0]


def by_sorting(rows):
    lists = {}
    for g, v, w in rows:
        if v is not None and w is not None and w > 0:
            lists.setdefault(g, []).extend([v] * w)
    out = {}
    for g, own in lists.items():
        own.sort()
        for p in PROBS:
            pos = p * (len(own) - 1)
            lo, hi = own[math.floor(pos)], own[math.ceil(pos)]
            out[g, p] = lo + (hi - lo) * (pos - math.floor(pos))
    return out


def rows_of(kind):
    rng = random.Random(8)
    if kind == "hot":  # a third of all rows has one value, most others are in one group
        rows = [("hot", 3.0 if rng.random() < 0.4 else rng.expovariate(1), 1) for _ in range(6000)] + [(None, rng.random(), 1) for _ in range(700)]
    elif kind == "weights":  # the ranks are where a sketch of the values does not look
        rows = [("a", rng.gauss(0, 1), 1) for _ in range(3000)] + [("a", 1e6 + k / 7, 2000) for k in range(60)] + [("b", float(k), 1 + k % 3) for k in range(900)]
    elif kind == "copies":
        rows = [("a", float(k % 2), 1) for k in range(2000)] + [("b", -0.0, 5)] * 900 + [("c", float(k), 1) for k in range(3)]
    else:
        rows = [("a", float(rng.randrange(400)), 1) for _ in range(2500)]
    return rows + [("a", None, 1), ("a", 5.0, 0), ("a", 5.0, None), ("empty", None, 3)]


@pytest.mark.parametrize("kind, most_rows", [("hot", 10), ("hot", 10**6), ("weights", 40), ("copies", 10), ("repeats", 3)])
def test_equal_to_sorting(spark, kind, most_rows):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(3)
    got = {(r.g, r.q): r["quantile"] for r in RK.exact_quantiles(df, ["g"], "v", PROBS, "w", most_rows=most_rows).collect()}
    want = by_sorting(rows)
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)


def test_whole_numbers_without_groups_and_without_rows(spark):
    df = spark.range(5000).selectExpr("id * 7 % 5000 AS v")
    got = {r.q: r["quantile"] for r in RK.exact_quantiles(df, [], "v", [0.25, 0.5, 0.9], most_rows=50).collect()}
    assert got == {0.25: 1249.75, 0.5: 2499.5, 0.9: pytest.approx(4499.1)}
    assert RK.exact_quantiles(df.filter("v < 0"), [], "v", [0.5]).count() == 0


def test_few_rows_are_moved(spark, monkeypatch):
    kept, real = [], RK.materialize

    def counted(df, name):
        out = real(df, name)
        if name == "between":
            kept.append(out.count())
        return out

    monkeypatch.setattr(RK, "materialize", counted)
    df = spark.range(400_000).selectExpr("id % 2 AS g", "hash(id) AS v")
    out = RK.exact_quantiles(df, ["g"], "v", [0.9, 0.995], most_rows=10_000).collect()
    assert len(out) == 4 and kept and sum(kept) < 0.05 * 400_000
