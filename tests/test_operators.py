"""Semantics that SQL twins cannot pin: published values, brute force, skewed groups, files and streams."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from fleetpulse import scratch_dir
from fleetpulse.fixed_values import MODEL_ATTRIBUTES
from fleetpulse.functions import responses as RE, scalars as SC, series as S, trends as T
from fleetpulse.functions.text import rounded_list, three_digits
from fleetpulse.operators import long_series as LS, metrics as M, neighbours as NB, perturb as B, ranking as RK, reconstruct as RC, sampling as R, windows as W
from fleetpulse.sources import daily_logs as D, window_store as WS


def label_of(spark, values):
    df = spark.createDataFrame([(values,)], "x array<double>")
    return df.select(T.series_label(F.col("x"))).first()[0]


@pytest.mark.parametrize("values, label", [
    ([0.0] * 10, "ZERO_OR_NEAR_ZERO"), ([7.0] * 10, "LOW_STABLE"), ([0.5] * 5, "ZERO_OR_NEAR_ZERO"), ([3.0], "LOW_STABLE"),
    ([float(i) for i in range(10)], "FAST_RISE"), ([float(9 - i) for i in range(10)], "FAST_DECAY"),
    ([0.0] * 5 + [9.0] * 5, "FAST_RISE"),
    ([0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], "SINGLE_SPIKE_EARLY"), ([0.0] * 8 + [10.0, 0.0], "SINGLE_SPIKE_LATE"),
    ([0.0, 10.0, 0.0, 10.0, 0.0, 10.0, 0.0, 10.0, 0.0, 10.0], "HIGH_RATE_BURSTS"),
    # a straight five-day ramp sits on the noise limit: the small constant decides
    ([0.0, 1.0, 2.0, 3.0, 4.0], "FAST_RISE"), ([0.0, 1.125e7, 2.25e7, 3.375e7, 4.5e7], "HIGH_RATE_BURSTS"),
])
def test_series_labels(spark, values, label):
    assert label_of(spark, values) == label


def test_cross_rules(spark):
    df = spark.createDataFrame([(["LOW_STABLE"] * 4,), (["FAST_RISE", "FAST_RISE", "LOW_STABLE", "LOW_STABLE"],),
                                (["STEP_DOWN", "LOW_STABLE", "LOW_STABLE", "LOW_STABLE"],)], "l array<string>")
    plain = [r[0] for r in df.select(T.cross_label(F.col("l"), ["other"] * 4)).collect()]
    assert plain == ["ALL_STABLE", "MULTI_ATTR_TRENDS", "RESET_OR_WRAP"]
    grouped = [r[0] for r in df.select(T.cross_label(F.col("l"), ["error", "wear", "wear", "workload"])).collect()]
    assert grouped == ["ALL_STABLE", "WEAROUT_WITH_ERRORS", "ERROR_BURST_WIDESPREAD"]


def test_sample_keeps_every_failure(spark):
    rows = [(i, 1) for i in range(4)] + [(i, 0) for i in range(4, 104)]
    df = spark.createDataFrame(rows, "id int, y int").withColumn("g", F.lit("x"))
    got = R.by_ratio(df, ["g"], ["id"], 2.0)
    assert got.filter("y = 1").count() == 4 and got.filter("y = 0").count() == 8
    assert sorted(got.collect()) == sorted(R.by_ratio(df.repartition(7), ["g"], ["id"], 2.0).collect())
    with pytest.raises(ValueError):
        R.require_both_classes(R.class_counts(df.filter("y = 0"), ["g"]))


def test_published_sampling_counts(spark):
    # failed, healthy -> sampled healthy at 1:23
    for failed, healthy, want in [(70, 911682, 1610), (144, 1030484, 3312), (167, 1012863, 3841), (406, 1235388, 9338)]:
        df = spark.createDataFrame([(failed, healthy)], "n_failed long, n_healthy long")
        assert df.select(F.least("n_healthy", F.bround(F.col("n_failed") * 23.0, 0).cast("long"))).first()[0] == want


def test_status_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "true_status int, pred_status int").withColumn("g", F.lit(0))
    r = M.with_rates(M.confusion(df, ["g"])).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 1, 1) and r.fpr == r.fnr == r.precision == r.recall == 0.5


# published rows (P, R, F0.5, failed, healthy) and their counts (tp, fp)
PUBLISHED = [(0.52, 0.35, 0.47, 368, 8464, 129, 119), (0.68, 0.33, 0.56, 1057, 24311, 348, 164),
             (0.63, 0.24, 0.48, 368, 8464, 89, 52), (0.57, 0.17, 0.39, 1057, 24311, 182, 137), (0.0, 0.0, 0.0, 368, 8464, 0, 85)]


def test_reconstruction_of_published_rows(spark):
    rows = [(i, *p[:5]) for i, p in enumerate(PUBLISHED)]
    df = spark.createDataFrame(rows, "k int, p double, r double, f double, pos long, neg long")
    got = {r.k: (r.tp, r.fp) for r in RC.reconstruct(df, ["k"]).collect()}
    assert got == {i: p[5:] for i, p in enumerate(PUBLISHED)}


def half_up(x):
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(str(x)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


def brute_reconstruct(p, r, f, pos, neg):
    found = []
    for tp in range(pos + 1):
        rec = tp / pos
        if half_up(rec) != r:
            continue
        # a published precision of 0 is searched at tp = 0, fp = 0 only
        last = max(0, math.floor(tp / (p - 0.005) - tp - 1e-12)) if p > 0 else (0 if tp == 0 else -1)
        for fp in range(0, min(neg, last) + 1):
            prec = tp / (tp + fp) if tp + fp else 0.0
            score = 1.25 * prec * rec / (0.25 * prec + rec) if prec + rec else 0.0
            if half_up(prec) == p and half_up(score) == f:
                found.append((abs(prec - p) + abs(rec - r) + abs(score - f), tp + fp, fp, tp))
    return len(found), (min(found)[3], min(found)[2]) if found else None


def test_reconstruction_matches_brute_force(spark):
    rng, rows = random.Random(3), []
    while len(rows) < 25:
        pos, neg = rng.randint(20, 160), rng.randint(50, 900)
        tp, fp = rng.randint(1, pos), rng.randint(0, neg // 2)
        p, r = tp / (tp + fp), tp / pos
        rows.append((len(rows), half_up(p), half_up(r), half_up(1.25 * p * r / (0.25 * p + r)), pos, neg))
    df = spark.createDataFrame(rows, "k int, p double, r double, f double, pos long, neg long")
    got = {x.k: (x.candidate_count, (x.tp, x.fp)) for x in RC.reconstruct(df, ["k"]).collect()}
    for k, *row in rows:
        count, best = brute_reconstruct(*row)
        assert got[k][0] == count and (best is None or got[k][1] == best), (k, row)


def test_exact_quantiles_with_weights_and_copies(spark):
    rng = random.Random(1)
    values = [7.0] * 400 + [rng.uniform(0, 100) for _ in range(601)]
    df = spark.createDataFrame([("a", v, 1 + i % 3) for i, v in enumerate(values)], "g string, v double, w int")
    flat = sorted(v for i, v in enumerate(values) for _ in range(1 + i % 3))
    for row in RK.exact_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0], "w", most_rows=20).collect():
        pos = row.q * (len(flat) - 1)
        lo, hi = flat[math.floor(pos)], flat[math.ceil(pos)]
        assert math.isclose(row["quantile"], lo + (hi - lo) * (pos - math.floor(pos)), rel_tol=1e-12)


def test_hot_series_is_cut_and_stays_whole(spark):
    rng = random.Random(5)
    rows = [("hot", i, None if rng.random() < 0.3 else float(i)) for i in range(3000)] + [
        (f"d{j}", i, None if i < 3 else float(i)) for j in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, t int, v double").withColumn("block", F.floor(F.col("t") / 100))
    filled = LS.fill_long(df, ["k"], ["t"], "block", ["v"])
    w = "partition by k order by t rows between unbounded preceding and"
    df.createOrReplaceTempView("hot_rows")
    want = spark.sql(f"select k, t, coalesce(last(v, true) over ({w} current row), first(v, true) over ({w} unbounded following)) v from hot_rows")
    assert sorted(filled.select("k", "t", "v").collect()) == sorted(want.collect())
    numbered = LS.number_rows(filled, ["k"], ["t"], "block")
    wins = LS.row_windows_long(numbered, ["k"], ["v"], 30, chunk_rows=64).select("k", "t", F.array_join("v", ",").alias("v"))
    filled.createOrReplaceTempView("hot_filled")
    plain = spark.sql("select k, t, array_join(collect_list(v) over (partition by k order by t rows 29 preceding), ',') v, "
                      "row_number() over (partition by k order by t) n from hot_filled").filter("n >= 30").drop("n")
    assert sorted(wins.collect()) == sorted(plain.collect())


def test_neighbour_vote_matches_brute_force(spark):
    rng = random.Random(2)
    base = [([rng.gauss(0, 1) for _ in range(6)], rng.randint(0, 1)) for _ in range(120)]
    train = base + [base[0]] * 80 + [(base[0][0], 1 - base[0][1])] * 3  # a third of the rows are copies
    asked = [(i, [rng.gauss(0, 1.2) for _ in range(6)]) for i in range(60)] + [(60, base[0][0])]
    tdf = spark.createDataFrame(train, "v array<double>, y int")
    got = {r.id: r.score for r in NB.knn_vote(tdf, spark.createDataFrame(asked, "id int, v array<double>"), "v", block_rows=50).collect()}
    for i, q in asked:
        near = sorted((round(math.dist(q, v), 9), y) for v, y in train)[:5]
        exact = [y for d, y in near if d == 0]
        want = sum(exact) / len(exact) if exact else sum(y / d for d, y in near) / sum(1 / d for d, _ in near)
        assert math.isclose(got[i], want, rel_tol=1e-9), i


def test_one_row_per_day(spark):
    df = spark.createDataFrame([("a", 1, "d1", 1.0, None), ("a", 1, "d1", 3.0, None), ("a", 1, "d1", None, 2.0), ("a", 1, "d2", None, None), ("a", None, "d1", 5.0, None)],
                               "model string, disk_id int, day string, u double, v double")
    assert {tuple(r) for r in W.one_row_per_day(df, ["u", "v"]).collect()} == {("a", 1, "d1", 3.0, 2.0), ("a", 1, "d2", None, None), ("a", None, "d1", 5.0, None)}


def test_neighbour_vote_by_group(spark):
    train = spark.createDataFrame([("a", [0.0, 0.0], 1), ("a", [9.0, 0.0], 0), ("b", [0.0, 1.0], 0)], "g string, v array<double>, y int")
    asked = spark.createDataFrame([(1, "a", [0.0, 0.0]), (2, "b", [0.0, 0.0]), (3, "c", [0.0, 0.0]), (4, "a", [3.0, 0.0]), (5, None, [0.0, 0.0])], "id int, g string, v array<double>")
    got = {r.id: r.score for r in NB.knn_vote(train, asked, "v", ["g"]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: None, 4: pytest.approx((1 / 3) / (1 / 3 + 1 / 6)), 5: None}


def test_python_number_text(spark):
    values = [0.5, 1235.0, 1225.0, 123456.0, 0.0, 1e-5, 8e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(three_digits("v")).collect()] == [f"{v:.3g}" for v in values]
    one = spark.createDataFrame([([1.0, 2.34567, 1e8],)], "x array<double>")
    assert one.select(rounded_list("x")).first()[0] == "[1.0, 2.346, 100000000.0]"


def test_json_block_and_status(spark):
    df = spark.createDataFrame([('prefix {"status":"AT_RISK","ttf_bucket":"<7"} suffix',), ("none",), ("{broken",), ("a {b} c",)], "raw_text string")
    rows = RE.parse_answers(df).collect()
    assert (rows[0].pred_status, rows[0].pred_ttf_bucket, rows[0].concern_level) == (1, "<7", "LOW concern")
    assert [r.parse_error for r in rows] == [None, "no JSON object", "no JSON object", "bad JSON"]


def test_risk_ramps(spark):
    df = spark.createDataFrame([([0.0] * 10,), ([-5.0] * 10,), ([100.0] * 4,)], "x array<double>")
    ups = [r[0] for r in df.select(B.raise_risk(F.col("x"))).collect()]
    assert ups[0][:3] == [0.0] * 3 and math.isclose(ups[0][3], 1.0) and math.isclose(ups[0][9], 2.0)
    assert ups[1][:3] == [0.0] * 3 and math.isclose(ups[2][0], 130.0) and math.isclose(ups[2][3], 160.0)
    assert df.select(B.lower_risk(F.col("x"))).collect()[1][0] == [0.0] * 10


def test_histogram_edges(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 10.0, -1.0, 12.0, float("nan")],)], "x array<double>")
    shares = df.select(S.histogram_shares(F.col("x"), F.lit(0.0), F.lit(10.0), 5)).first()[0]
    # -1 is ignored, 10 and 12 go to the last bin, the share is of the six finite days
    assert [round(s * 6) for s in shares] == [2, 1, 0, 0, 2]


def test_patch_remainder_and_short_series(spark):
    df = spark.createDataFrame([([float(i) for i in range(30)],), ([1.0, 2.0],)], "x array<double>")
    cut = [r[0] for r in df.select(S.patches(F.col("x"), 4)).collect()]
    assert len(cut[0]) == 7 and cut[0][-1] == [24.0, 25.0, 26.0, 27.0] and cut[1] == []


def test_split_rule_of_24_months(spark):
    rule = W.SplitRule()
    df = spark.createDataFrame([(m,) for m in range(1, 26)], "m int")
    for r, (test, val) in {1: (24, 23), 2: (23, 22), 3: (22, 21)}.items():
        got = {x.m: x.s for x in df.select("m", rule.split(F.col("m"), r).alias("s")).collect()}
        assert got[test] == "test" and got[val] == "val" and got[val - 1] == got[1] == "train" and got[test + 1] is None


def test_dates_and_ttf(spark):
    df = spark.createDataFrame([("20180101", "2018-01-31 23:59:59"), ("2018", "20180105"), ("20181399", "soon")], "ds string, f string")
    rows = df.select(SC.parse_day(F.col("ds")).alias("d"), SC.parse_failure_time(F.col("f")).alias("f")).collect()
    assert rows[0].d == dt.date(2018, 1, 1) and rows[1].d is None and rows[2].d is None
    assert rows[0].f == dt.date(2018, 1, 31) and rows[1].f == dt.date(2018, 1, 5) and rows[2].f is None
    assert df.select(SC.days_to_failure(SC.parse_day(F.col("ds")), SC.parse_failure_time(F.col("f")))).first()[0] == 30


def write_days(spark, root):
    """One CSV per day under a year folder; the first two days are to be skipped."""
    import os

    for year, days in (("2018", range(1, 36)), ("2019", range(1, 3))):
        os.makedirs(f"{root}/log{year}", exist_ok=True)
        for d in days:
            day = dt.date(int(year), 1, 1) + dt.timedelta(days=d - 1)
            with open(f"{root}/log{year}/{day:%Y%m%d}.csv", "w") as f:
                f.write("disk_id,ds,model,r_5,r_9,n_x\n")
                f.writelines(f"{i},{day:%Y%m%d},{'MB1' if i < 3 else 'ZZ'},{d},{'' if d % 2 else i},1\n" for i in (1, 2, 3))


def test_daily_files_batch_and_stream(spark, tmp_path):
    root, extra = str(tmp_path / "logs"), str(tmp_path / "extra")
    write_days(spark, root)
    schema = "disk_id long, ds int, model string, r_5 double, r_9 double, n_x double"
    from pyspark.sql.types import StructType

    typed = StructType.fromDDL(schema)
    logs = D.read_daily_logs(spark, [f"{root}/log2018", f"{root}/log2019"], typed)
    assert logs.count() == 3 * 37 and D.without_skipped_days(logs).count() == 3 * 35
    mb1 = D.project_model(logs, "MB1")
    assert mb1.columns == ["disk_id", "ds", "model", "r_5", "r_9"] and mb1.count() == 2 * 37
    counts = {r.model: r.n for r in D.rows_per_model(logs).collect()}
    assert counts["MB1"] == 74 and counts["MA1"] == 0 and set(counts) == set(MODEL_ATTRIBUTES)
    with pytest.raises(ValueError):
        D.project_model(logs.drop("ds"), "MB1")

    import os

    os.makedirs(f"{extra}/log2020")
    with open(f"{extra}/log2020/20200101.csv", "w") as f:
        f.write("model,disk_id,ds,r_12\nMB1,1,20200101,5\n")
    mixed = D.read_daily_logs(spark, [f"{root}/log2018", f"{root}/log2019", f"{extra}/log2020"], skipped=["20180101.csv", "20180102.csv"])
    assert mixed.count() == 3 * 35 + 1
    last = D.project_model(mixed, "MB1").filter("ds = 20200101").first()
    assert last.r_12 == 5.0 and last.r_5 is None and last.disk_id == 1
    with open(f"{extra}/log2020/20200102.csv", "w") as f:  # another header in the same folder
        f.write("disk_id,ds,model,r_5\nx,20200102,MB1,7\n2,20200102,MB1,8\n")
    both = D.read_daily_logs(spark, [f"{extra}/log2020"])
    assert both.count() == 3 and both.filter("r_5 = 8.0 and r_12 is null").count() == 1
    os.makedirs(f"{extra}/bad")
    with open(f"{extra}/bad/20200103.csv", "w") as f:
        f.write("disk_id,model\n1,MB1\n")
    with pytest.raises(ValueError, match="20200103"):
        D.read_daily_logs(spark, [f"{extra}/bad"])

    from fleetpulse.plans.data import evaluation_index, store_windows

    tags = spark.createDataFrame([("MB1", 1, "2019-01-02 10:00:00")], "model string, disk_id long, failure_time string")
    rule = W.SplitRule(last_month=3, val=1, test=1, rounds=(1,))
    wins = store_windows(spark, [f"{root}/log{y}" for y in (2018, 2019)], tags, "MB1", f"{extra}/windows", rule, size=30)
    # 35 kept days per device give six windows; those of January 2019 are the test month
    assert wins.groupBy("split").count().orderBy("split").collect() == [("test", 4), ("val", 8)]
    assert wins.filter("disk_id = 1 and split = 'test'").agg(F.sum("y")).first()[0] == 2
    index, summary = evaluation_index(wins, ratio=1.0)
    assert index.count() == 4 and summary.first().selected_failed == 2

    from fleetpulse.plans.data import store_fleet
    from fleetpulse.sources.window_store import read_store

    assert D.write_day_files(D.read_daily_logs(spark, [root], typed).withColumn("model", F.when(F.col("disk_id") == 1, "MA1").otherwise("MB1")), f"{extra}/two") > 30
    assert "20180101.csv" in os.listdir(f"{extra}/two")
    known = store_fleet(spark, [f"{extra}/two"], tags, ["MA1", "MB1"], f"{extra}/fleet", rule, size=30)
    for m in ("MA1", "MB1"):
        own = store_windows(spark, [f"{extra}/two"], tags, m, f"{extra}/alone-{m}", rule, size=30)
        features = [c for c in own.columns if c.startswith("r_")]
        assert features and set(features) <= set(known)
        cols = ["disk_id", "end_day", "split", "y", *features]
        same = read_store(spark, f"{extra}/fleet", features, 30, m)
        assert own.count() and sorted(same.select(*cols).collect()) == sorted(own.select(*cols).collect())

    from fleetpulse.streaming.daily_ingest import ingest

    for _ in range(2):  # the second run finds nothing new
        ingest(spark, root, f"{extra}/out", f"{extra}/ck", typed, files_per_batch=3).awaitTermination()
    batch = D.project_model(D.read_daily_logs(spark, [root], typed, ["20180101.csv", "20180102.csv"]), "MB1")
    stored = spark.read.parquet(f"{extra}/out")
    assert stored.count() == batch.count() == 70
    assert sorted(stored.select("disk_id", "ds", "r_5").collect()) == sorted(batch.select("disk_id", "ds", "r_5").collect())
    os.makedirs(f"{root}/log2021")
    with open(f"{root}/log2021/20210101.csv", "w") as f:  # another order of columns, and one that this model does not keep
        f.write("r_9,ds,model,n_x,r_5,disk_id\n9,20210101,MB1,1,5,77\n")
    ingest(spark, root, f"{extra}/out", f"{extra}/ck", typed).awaitTermination()
    last = spark.read.parquet(f"{extra}/out").filter("disk_id = 77").first()
    assert (last.r_5, last.r_9, last.ds) == (5.0, 9.0, 20210101) and spark.read.parquet(f"{extra}/out").count() == 71


def test_headers_are_found_without_reading_the_files(spark, tmp_path):
    import io

    class Counted(io.BytesIO):
        given = 0

        def read(self, n=-1):
            more = super().read(n)
            self.given += len(more)
            return more

    big = Counted(b"disk_id,ds,model\r\n" + b"1,20180101,MB1\n" * 200_000)
    assert D.first_line(big) == "disk_id,ds,model" and big.given <= D.HEADER_BYTES
    wide = Counted("é,".encode() * 100_000 + b"\n1\n")  # a header longer than a step
    assert D.first_line(wide) == "é," * 100_000 and D.first_line(Counted(b"")) is None and D.first_line(Counted(b"\n1")) == ""
    lines = {"a b.csv": "\ufeffdisk_id,ds,model\n1,20180101,MB1\n", "c%20d.csv": "ds,model,disk_id\r\n20180101,MB1,2\r\n", "e.csv": "", "f.csv": "disk_id,ds,model"}
    for name, text in lines.items():
        (tmp_path / name).write_bytes(text.encode())
    found = {r.header: len(r.files) for r in D.file_headers(spark, [str(tmp_path)]).collect()}
    assert found == {"\ufeffdisk_id,ds,model": 1, "ds,model,disk_id": 1, "disk_id,ds,model": 1}
    assert sorted(r.disk_id for r in D.read_daily_logs(spark, [f"file://{tmp_path}"]).collect()) == [1, 2]
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.csv").write_bytes(b"ds,model,disk_id\n20180101,MB1,7\n")
    scanned = D.read_daily_logs(spark, [str(plain)], stores=frozenset())
    assert [r.disk_id for r in scanned.collect()] == [7]


def test_window_store_rewrites_only_its_partitions(spark):
    path = scratch_dir(spark, "test-windows")
    rows = [("MB1", r, s, 1, dt.date(2020, 1, 1), 0) for r in (1, 2) for s in ("train", "test")]
    df = spark.createDataFrame(rows, "model string, round int, split string, disk_id long, end_day date, y int")
    WS.write_windows(df, path)
    WS.write_windows(df.filter("round = 2 and split = 'test'").withColumn("y", F.lit(1)), path)
    assert WS.read_split(spark, path).agg(F.count("*"), F.sum("y")).first()[:] == (4, 1)
    assert WS.find_label(df.withColumnRenamed("y", "Labels")) == "Labels"


def test_pattern_plan_end_to_end(spark):
    from fleetpulse.operators.patterns import PatchShape
    from fleetpulse.plans import patterns as PP
    from fleetpulse.registry import fixtures as X

    sf = "/root/testdata/sf0.001"
    rows = X.imputed(spark, sf)
    memory = PP.learn(rows, X.failure_tags(spark, sf), X.RULE, X.FEATURES, shape=PatchShape(4, 30), groups=X.GROUPS, attr_k=4, cross_k=3)
    wins = PP.assign(rows, X.failure_tags(spark, sf), X.RULE, memory)
    text = PP.describe(wins.withColumn("test_index", F.lit(0)), memory, "test_index").filter("split = 'test'").select("summary").first()[0]
    # four-day patches leave two days over, so novel parts carry no raw values
    assert text.startswith("Window index: 0\n\nAttribute-level patterns") and "raw_stats" not in text
    assert memory.attr_vocab.count() == 8 and memory.cross_vocab.filter("kind = 'cross'").count() == 6
