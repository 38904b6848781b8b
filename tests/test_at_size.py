"""Work that larger tables multiply is done on matrices and in generated code, with the results of the plain forms."""

from __future__ import annotations

import bisect
import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from fleetpulse.functions import series as S, text as X, trends as T
from fleetpulse.operators import features as FX, neighbours as NB, patterns as PT, ranking as RK, sampling as R, windows as W


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cuts_below_a_value_without_interpreted_steps(spark):
    cuts = [1.0, 2.0, 2.5, 7.0, 9.0]
    df = spark.createDataFrame([(float(v) / 2, cuts) for v in range(-2, 24)], "v double, cuts array<double>")
    placed = RK.with_cuts_below(df, "cuts", "v", 7, "n")
    assert "lambda" not in plan_of(placed)
    assert {r.v: r.n for r in placed.collect()} == {v / 2: bisect.bisect_left(cuts, v / 2) for v in range(-2, 24)}


def test_nearest_prototypes_of_a_batch_equal_the_column_form(spark):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(300)] + [None, [1.0, 2.0], [1.0, None, 0.0, 0.0, 0.0], [0.0] * 5]
    rows = spark.createDataFrame([(i, "ABC"[i % 3], v) for i, v in enumerate(vectors)], "id int, model string, emb array<double>")
    protos = spark.createDataFrame([(m, k, [rng.gauss(0, 1) for _ in range(5)]) for m in "AB" for k in range(4)] + [("B", 4, [0.0] * 5), ("B", 5, [0.0] * 5)],
                                   "model string, k int, center array<double>")
    found = PT.match(rows, protos)
    assert "lambda" not in plan_of(found)
    plain = rows.join(PT.center_lists(protos), "model").withColumn("n", PT.nearest(F.col("emb"), F.col("centers"))).select("id", "n.k", "n.dist")
    assert {r.id: (r.proto if r.dist is not None else None, r.dist) for r in found.collect()} == {r.id: (r.k if r.dist is not None else None, r.dist) for r in plain.collect()}


def test_patches_leave_holes_out_and_flat_assignments_are_not_interpreted(spark):
    rows = spark.createDataFrame([("A", 1, d, None if d == 3 else float(d), float(-d)) for d in range(1, 8)], "model string, disk_id int, day int, x double, z_x double")
    shape = PT.PatchShape(days=3, window=6)
    got = {r.day: (r.raw_x, r.zp_x) for r in PT.with_patches(rows, ["x"], shape).collect()}
    assert got[2] == (None, None) and got[3] == ([1.0, 2.0], [-1.0, -2.0, -3.0]) and got[7] == ([5.0, 6.0, 7.0], [-5.0, -6.0, -7.0])
    one = "struct<proto:int,novel:boolean,dist:double>"
    windows = spark.createDataFrame([Row("A", 1, 6, "train", 0, [(0, False, 0.5), (1, True, 2.0)], [(2, True, 1.0), (3, False, 4.0)])],
                                    f"model string, disk_id int, end_day int, split string, y int, p_x array<{one}>, p_cross array<{one}>")
    flat = PT.long_assignments(windows, ["x"])
    assert "lambda" not in plan_of(flat)
    assert sorted((r.kind, r.attr or "", r.p, r.proto, r.novel, r.dist) for r in flat.collect()) == [
        ("attr", "x", 0, 0, False, 0.5), ("attr", "x", 1, 1, True, 2.0), ("cross", "", 0, 2, True, 1.0), ("cross", "", 1, 3, False, 4.0)]


def test_rows_past_a_limit_are_dropped_before_they_move(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id"))
    capped = R.capped(df, ["g"], ["id"], 50)
    assert "SortMergeJoin" not in plan_of(capped) and "BroadcastHashJoin" in plan_of(capped)
    assert capped.count() == 50


def test_whole_numbers_as_text(spark):
    df = spark.createDataFrame([(1, [0.5, -0.5, 1.4999999, None, -2.6]), (2, []), (3, None), (4, [0.49999999999999994, 2.5])], "id int, xs array<double>")
    shown = df.select("id", X.whole_numbers(F.col("xs")).alias("t"))
    assert "lambda" not in plan_of(shown)
    assert {r.id: r.t for r in shown.collect()} == {1: "1,-1,1,-3", 2: "", 3: None, 4: "0,3"}
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([([float("nan")],)], "xs array<double>").select(X.whole_numbers(F.col("xs"))).collect()


def test_shares_of_bins(spark):
    rows = [([0.0, 1.0, 5.0, 9.9, 10.0, 12.0, -3.0, None, float("nan")], 0.0, 10.0), ([], 0.0, 1.0), ([4.0], None, 1.0)]
    df = spark.createDataFrame(rows, "xs array<double>, lo double, hi double").select(S.histogram_shares(F.col("xs"), F.col("lo"), F.col("hi"), 2).alias("s"))
    assert "lambda" not in plan_of(df)
    assert [r.s for r in df.collect()] == [[2 / 7, 4 / 7], [0.0, 0.0], [0.0, 0.0]]


def test_labels_of_a_batch_equal_the_column_form(spark):
    rng = np.random.default_rng(5)
    made = [[], [0.0], [5.0], [0.5] * 6, [3.0] * 6, [0.0, 0.0, 1e-13], None, [1.0, None, 2.0], [1.0, float("nan"), 2.0]]
    for size in (2, 3, 5, 30):
        for scale in (1e-8, 0.3, 40.0):
            made += [(scale * f).tolist() for f in rng.normal(size=(40, size)).cumsum(axis=1)]
            made += [(scale * f).tolist() for f in (rng.random((40, size)) < 0.1) * 1.0 + rng.random((40, size)) * 0.05]
            made += [(scale * f).tolist() for f in np.sort(rng.random((20, size)), axis=1) ** 3 - rng.integers(0, 2, (20, 1))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(made)], "id int, xs array<double>")
    got = df.select("id", T.series_labels(F.col("xs")).alias("a"), T.series_label(F.col("xs")).alias("b")).collect()
    assert [(r.id, r.a) for r in got] == [(r.id, r.b) for r in got]
    assert len({r.a for r in got}) > 10


def test_blocks_of_the_neighbour_vote_are_compared_without_copies(spark):
    rng = np.random.default_rng(7)
    train = [("AB"[i % 2], v.tolist(), int(i % 3 == 0)) for i, v in enumerate(rng.normal(size=(120, 8)))]
    asked = [(i, "ABC"[i % 3], v.tolist()) for i, v in enumerate(rng.normal(size=(90, 8)))]
    tdf, qdf = spark.createDataFrame(train, "g string, v array<double>, y int"), spark.createDataFrame(asked, "id int, g string, v array<double>")
    few, many = (NB.knn_vote(tdf, qdf, "v", ["g"], block_rows=n) for n in (1000, 7))
    assert "CartesianProduct" in plan_of(many) and "Generate" not in plan_of(many) and "CoGroup" not in plan_of(many)
    got = {r.id: r.score for r in many.collect()}
    assert got == pytest.approx({r.id: r.score for r in few.collect()})
    assert {i for i, v in got.items() if v is None} == {i for i, g, _ in asked if g == "C"}


def test_phrases_of_a_split_need_only_the_rows_its_windows_hold(spark):
    rng = random.Random(11)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=2 * d) for d in range(150)]
    made = [("A", disk, day, float(rng.randint(0, 3))) for disk in (1, 2, 3) for day in days if disk < 3 or day.month > 5]
    made += [("A", 1, None, 1.0), ("A", 4, days[-1], 1.0), (None, 5, days[-1], 2.0)]
    daily = spark.createDataFrame(made, "model string, disk_id int, day date, x double")
    months, rule = W.month_index(daily.filter("day is not null")), W.SplitRule(last_month=7, val=1, test=2)
    cut = W.rows_of_split(daily, months, rule, "test", size=9)

    def phrases(rows):
        found = W.split_windows(FX.frame_phrases(rows, ["x"], 9), months, rule, (1,)).filter("split = 'test'")
        return sorted((r.disk_id, r.end_day, r.x_phrase) for r in found.collect())

    assert cut.columns == daily.columns
    assert phrases(cut) == phrases(daily) and len(phrases(cut)) > 70
    assert cut.count() < len(made) / 2


def test_series_statistics_of_a_batch_equal_the_column_form(spark):
    nan, inf, rng = math.nan, math.inf, random.Random(5)
    xs = [[rng.choice([0.0, 1.0, rng.gauss(0, 10)]) for _ in range(n)] for n in (1, 2, 3, 30, 30, 30)]
    xs += [None, [], [None], [None, None], [1.0, None, 3.0], [None, 2.0, 3.0], [1.0, nan, 2.0], [nan], [nan, None, 2.0, 3.0, 1.0], [inf, 1.0, -inf], [inf], [4.0, 4.0]]
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, x array<double>")
    made = rows.select("i", S.series_stats(F.col("x")).alias("s"))
    assert "lambda" not in plan_of(made)

    def plain(x):
        return S.let(S.diffs(x), lambda d: S.let(F.transform(d, F.abs), lambda steps: F.struct(
            F.size(x).alias("L"), F.coalesce(S.mean(x), F.lit(0.0)), F.coalesce(S.std_pop(x), F.lit(0.0)), F.coalesce(S.last(x) - S.first(x), F.lit(0.0)),
            F.coalesce(F.array_max(x) - F.array_min(x), F.lit(0.0)), *[F.when(F.size(x) > 1, v).otherwise(F.lit(0.0)) for v in (
                F.array_max(steps), S.mean(steps), S.std_pop(d), S.arg_first(steps, F.array_max(steps)) / (F.size(x) - 1))])))

    want = {r.i: repr(tuple(r.s)) for r in rows.select("i", S.let(F.col("x"), plain).alias("s")).collect()}
    assert {r.i: repr(tuple(r.s)) for r in made.collect()} == want


def test_sequences_of_windows_equal_those_of_frames(spark):
    rng = random.Random(6)
    days = [("m", disk, day, *(rng.choice([0.0, 5.0, rng.gauss(100, 30), rng.gauss(0, 1e-5)]) if disk else 4.0 for _ in "ab")) for disk in range(4) for day in range(50)]
    days[60] = ("m", 1, 10, math.inf, math.nan)
    daily = spark.createDataFrame(days, "model string, disk_id int, day int, a double, b double")
    made = FX.with_sequences(W.row_windows(daily, ["a", "b"]), ["a", "b"])
    assert "var_pop" not in plan_of(made) and "kurtosis" not in plan_of(made)
    found = {(r.disk_id, r.end_day): repr((r.a_seq, r.b_seq)) for r in made.collect()}
    want = {(r.disk_id, r.end_day): repr((r.a_seq, r.b_seq)) for r in W.row_windows(FX.sequence_frames(daily, ["a", "b"]), []).collect()}
    assert found == want and len(found) == 4 * 21
