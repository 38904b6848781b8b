"""Scans, sinks, projections, imputation, windows, labels and splits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from fleetpulse import scratch_dir
from fleetpulse.functions.scalars import parse_day
from fleetpulse.functions import series as S
from fleetpulse.operators import incremental as I, long_series as LS, windows as W
from fleetpulse.registry import fixtures as X
from fleetpulse.registry.catalog import query
from fleetpulse.registry.fixtures import FEATURES, RULE, r6
from fleetpulse.sources import daily_logs as D, evaluation_io as E, window_store as WS

LOG_SCHEMA = D.log_schema(FEATURES)
SUMS = ", ".join(f"sum({c}) as {c}" for c in FEATURES)


def feature_sums(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in FEATURES])


def windows(spark, sf, arrays=True, rounds=(1,)):
    return W.build_windows(X.telemetry(spark, sf), X.failure_tags(spark, sf), FEATURES, RULE, keep_arrays=arrays,
                           rounds=rounds)


def year_folders(spark, sf):
    """The daily log written as CSV, one folder per year."""
    path = scratch_dir(spark, "daily")
    rows = X.raw_log(spark, sf).withColumn("log_year", F.floor(F.col("ds") / 10000))
    rows.repartition("log_year").write.partitionBy("log_year").option("header", True).csv(path)
    years = [r[0] for r in rows.select("log_year").distinct().orderBy("log_year").collect()]
    return [f"{path}/log_year={y}" for y in years]


@query("s1_scan_daily_logs", f"with {X.TELEMETRY} select model, year(day) as yr, count(*) as n, {SUMS} from tel group by 1, 2")
def s1(spark, sf):
    logs = D.read_daily_logs(spark, year_folders(spark, sf), LOG_SCHEMA)
    return feature_sums(D.with_day(logs), "model", F.year("day").alias("yr"))


@query("s2_scan_model_logs_skip_days", f"""with {X.TELEMETRY} select count(*) as n, count(distinct disk_id) as disks, {SUMS}
from tel where model = 'MB1' and strftime(day, '%Y-%m') <> '1995-06' and strftime(day, '%Y%m%d') not in ('19940301', '19960229')""")
def s2(spark, sf):
    path = scratch_dir(spark, "model-logs")
    D.write_day_files(X.raw_log(spark, sf).filter("model = 'MB1'"), path)
    skipped = [*(f"199506{k:02d}.csv" for k in range(1, 31)), "19940301.csv", "19960229.csv"]
    kept = D.read_daily_logs(spark, [path], LOG_SCHEMA, skipped)
    return kept.agg(F.count("*").alias("n"), F.countDistinct("disk_id").alias("disks"),
                    *[F.sum(c).alias(c) for c in FEATURES])


@query("s1_mixed_headers", f"""with {X.TELEMETRY} select model, count(*) as n, sum(r_5) as r_5, sum(case when disk_id % 3 = 1 then null else r_187 end) as r_187,
sum(case when disk_id % 3 = 2 then r_241 end) as r_241 from tel group by 1""")
def s1_mixed(spark, sf):
    """One folder whose files have three headers: all columns, one left out, and another order with one left out."""
    path, rows = scratch_dir(spark, "mixed"), X.raw_log(spark, sf)
    orders = [["disk_id", "ds", "model", "r_5", "r_187"], ["model", "r_5", "disk_id", "ds"], ["ds", "model", "disk_id", "r_241", "r_187", "r_5"]]
    for k, columns in enumerate(orders):
        rows.filter(F.col("disk_id") % 3 == k).select(*columns).write.mode("append").option("header", True).csv(path)
    logs = D.read_daily_logs(spark, [path], LOG_SCHEMA)
    return logs.groupBy("model").agg(F.count("*").alias("n"), F.sum("r_5").alias("r_5"), F.sum("r_187").alias("r_187"), F.sum("r_241").alias("r_241"))


@query("s3_scan_failure_tags", """select case when (l_suppkey // 2) % 2 = 0 then 'MB1' else 'MB2' end as model,
  count(*) as n, count(distinct l_suppkey) as disks, strftime(min(l_shipdate), '%Y-%m-%d') as first_failure
from lineitem where l_returnflag = 'R' and l_quantity >= 45 and l_discount >= 0.09
  and l_shipdate >= timestamp '1997-01-01' and l_suppkey % 2 = 0 group by 1""")
def s3(spark, sf):
    path = scratch_dir(spark, "tags")
    tags = X.failure_tags(spark, sf).select(F.substring("model", 2, 2).alias("model"), "failure_time", "disk_id")
    tags.write.option("header", True).csv(path)
    from fleetpulse.functions.scalars import parse_failure_time

    day = parse_failure_time(F.col("failure_time"))
    return D.read_failure_tags(spark, path).groupBy("model").agg(
        F.count("*").alias("n"), F.countDistinct("disk_id").alias("disks"), F.min(day).cast("string").alias("first_failure"))


@query("p1_project_model", f"with {X.TELEMETRY} select disk_id, cast(strftime(day, '%Y%m%d') as int) as ds, model, r_5, r_187, r_197, r_241 from tel where model = 'MB2'")
def p1(spark, sf):
    return D.project_model(X.raw_log(spark, sf), "MB2")


@query("p2_required_columns", f"with {X.TELEMETRY} select 'ds' as missing_column, count(*) as n from tel")
def p2(spark, sf):
    rows, path = X.raw_log(spark, sf), scratch_dir(spark, "incomplete")
    rows.write.option("header", True).csv(path)
    rows.limit(1).drop("ds").write.mode("append").option("header", True).csv(path)  # one file of many lacks a column
    try:
        D.read_daily_logs(spark, [path], LOG_SCHEMA)
        missing = ""
    except ValueError as exc:
        missing = "ds" if "'ds'" in str(exc) else str(exc)
    return rows.agg(F.count("*").alias("n")).withColumn("missing_column", F.lit(missing))


@query("p3_reorder_features", f"with {X.TELEMETRY} select model, disk_id, r_241, r_197, r_187, r_5, strftime(day, '%Y-%m-%d') as day from tel")
def p3(spark, sf):
    ordered = ["r_241", "r_197", "r_187", "r_5"]
    return X.telemetry(spark, sf).select("model", "disk_id", *ordered, F.col("day").cast("string").alias("day"))


@query("f1_parse_day", f"""with {X.TELEMETRY} select strftime(day, '%Y-%m-%d') as day, count(*) as n, 0 as bad from tel group by 1
union all select null, count(*), count(*) from tel""")
def f1(spark, sf):
    rows = X.raw_log(spark, sf).select(F.col("ds").cast("string").alias("ds"))
    broken = rows.select(F.concat(F.lit("x"), F.col("ds")).alias("ds"))
    days = rows.union(broken).select(parse_day(F.col("ds")).cast("string").alias("day"))
    return days.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("day").isNull()).alias("bad"))


@query("k1_write_model_logs", f"with {X.TELEMETRY} select model, strftime(day, '%Y%m%d') as day, count(*) as n, {SUMS} from tel group by 1, 2")
def k1(spark, sf):
    path = scratch_dir(spark, "by-model")
    D.write_model_logs(X.raw_log(spark, sf), path)
    back = spark.read.option("header", True).csv(path, schema=",".join(
        ["disk_id long", "ds int", *[f"{c} double" for c in FEATURES], "model string", "day_file int"]))
    return feature_sums(back, "model", F.col("day_file").cast("string").alias("day"))


@query("a1_rows_per_model", f"""with {X.TELEMETRY} select m.model, count(tel.model) as n
from (values ('MA1'), ('MA2'), ('MB1'), ('MB2'), ('MC1'), ('MC2')) m(model) left join tel on tel.model = m.model group by 1""")
def a1(spark, sf):
    return D.rows_per_model(X.raw_log(spark, sf))


@query("a2_earliest_failure", f"with {X.FAILURES} select model, disk_id, strftime(failure_day, '%Y-%m-%d') as failure_day from fail")
def a2(spark, sf):
    first = W.earliest_failures(X.failure_tags(spark, sf))
    return first.withColumn("failure_day", F.col("failure_day").cast("string"))


RATES = ", ".join(f"{r6(f'avg(case when {c} is null then 1.0 else 0.0 end)')} as {c}" for c in FEATURES)


@query("a3_null_rates", f"with {X.IMPUTED} select 'before' as stage, model, {RATES} from tel group by 2 union all select 'after', model, {RATES} from imp group by 2")
def a3(spark, sf):
    daily = X.telemetry(spark, sf)
    before = W.null_rates(daily, FEATURES).withColumn("stage", F.lit("before"))
    after = W.null_rates(W.impute(daily, FEATURES), FEATURES).withColumn("stage", F.lit("after"))
    return before.union(after).select("stage", "model", *[F.round(c, 6).alias(c) for c in FEATURES])


@query("a4_profile", f"""with {X.TELEMETRY} select model, count(*) as n_rows, count(distinct disk_id) as disks,
  strftime(min(day), '%Y-%m-%d') as first_day, strftime(max(day), '%Y-%m-%d') as last_day from tel group by 1""")
def a4(spark, sf):
    p = D.profile(X.telemetry(spark, sf))
    return p.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("a5_median_fallback", f"with {X.IMPUTED} select model, {', '.join(f'm_{c}' for c in FEATURES)} from med")
def a5(spark, sf):
    filled = W.fill_within_device(X.telemetry(spark, sf), FEATURES)
    med = W.feature_medians(filled, FEATURES)
    return med.select("model", *[F.col(f"median_{c}").alias(f"m_{c}") for c in FEATURES])


def day_text(df):
    return df.withColumn("day", F.col("day").cast("string"))


def ffill(c: str) -> str:
    return f"last_value({c} ignore nulls) over (partition by model, disk_id order by day rows between unbounded preceding and current row)"


@query("w1_forward_fill", f"with {X.TELEMETRY} select model, disk_id, strftime(day, '%Y-%m-%d') as day, {', '.join(f'{ffill(c)} as {c}' for c in FEATURES)} from tel")
def w1(spark, sf):
    daily = X.telemetry(spark, sf)
    return day_text(daily.select("model", "disk_id", "day", *[W.forward_fill(c).alias(c) for c in FEATURES]))


@query("w2_backward_fill", f"with {X.TELEMETRY} select model, disk_id, strftime(day, '%Y-%m-%d') as day, {', '.join(f'coalesce({ffill(c)}, first_value({c} ignore nulls) over (partition by model, disk_id order by day rows between current row and unbounded following)) as {c}' for c in FEATURES)} from tel")
def w2(spark, sf):
    return day_text(W.fill_within_device(X.telemetry(spark, sf), FEATURES).select("model", "disk_id", "day", *FEATURES))


@query("w1_w2_a5_impute", f"with {X.IMPUTED} select model, disk_id, strftime(day, '%Y-%m-%d') as day, {', '.join(FEATURES)} from imp")
def impute(spark, sf):
    return day_text(X.imputed(spark, sf).select("model", "disk_id", "day", *FEATURES))


@query("w1_w2_fill_long_series", """select event_id, coalesce(
  last_value(case when event_id % 3 = 0 then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row),
  first_value(case when event_id % 3 = 0 then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)) as v
from events""")
def fill_long(spark, sf):
    events = X.table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    blocks = events.select("event_id", "user_id", "ts", "v", F.to_date("ts").alias("block"))
    return LS.fill_long(blocks, ["user_id"], ["ts", "event_id"], "block", ["v"]).select("event_id", "v")


@query("w3_row_windows_long_series", f"""select event_id, n, {r6('lo')} as lo, {r6('hi')} as hi from (
  select event_id, count(*) over w as n, min(value) over w as lo, max(value) over w as hi from events
  window w as (partition by user_id order by ts, event_id rows between 29 preceding and current row)) where n = 30""")
def windows_long(spark, sf):
    events = X.table(spark, sf, "events").select("event_id", "user_id", "ts", "value", F.to_date("ts").alias("block"))
    numbered = LS.number_rows(events, ["user_id"], ["ts", "event_id"], "block")
    wins = LS.row_windows_long(numbered, ["user_id"], ["value"], 30, chunk_rows=48)
    return wins.select("event_id", F.size("value").alias("n"), F.round(F.array_min("value"), 6).alias("lo"),
                       F.round(F.array_max("value"), 6).alias("hi"))


WKEY = "model, disk_id, strftime(end_day, '%Y-%m-%d') as end_day"


def wkey(df, *cols):
    return df.select("model", "disk_id", F.col("end_day").cast("string").alias("end_day"), *cols)


@query("w3_row_windows", f"""with {X.IMPUTED} select model, disk_id, strftime(day, '%Y-%m-%d') as end_day, {', '.join(f'first_{c}, last_{c}, total_{c}' for c in FEATURES)} from (
  select *, {', '.join(f'first_value({c}) over w as first_{c}, last_value({c}) over w as last_{c}, sum({c}) over w as total_{c}' for c in FEATURES)}, count(*) over w as n from imp
  window w as (partition by model, disk_id order by day rows between 29 preceding and current row)) where n = 30""")
def w3(spark, sf):
    wins = W.row_windows(X.imputed(spark, sf), FEATURES)
    return wkey(wins, *[made for c in FEATURES for made in (
        S.first(F.col(c)).alias(f"first_{c}"), S.last(F.col(c)).alias(f"last_{c}"), S.total(F.col(c)).alias(f"total_{c}"))])


@query("w4_j2_month_index", f"with {X.TELEMETRY}, {X.MONTHS} select model, strftime(month, '%Y-%m') as month, month_idx, count(*) as n from months join tel using (model) where date_trunc('month', day) = month group by 1, 2, 3")
def w4(spark, sf):
    daily = X.telemetry(spark, sf)
    months = W.month_index(daily)
    rows = daily.withColumn("month", F.trunc("day", "month")).join(F.broadcast(months), ["model", "month"])
    return rows.groupBy("model", F.date_format("month", "yyyy-MM").alias("month"), "month_idx").agg(F.count("*").alias("n"))


@query("f3_month_period", f"with {X.TELEMETRY} select strftime(date_trunc('month', day), '%Y-%m-%d') as month, count(*) as n from tel group by 1")
def f3(spark, sf):
    from fleetpulse.functions.scalars import month_start

    rows = X.telemetry(spark, sf)
    return rows.groupBy(month_start(F.col("day")).cast("string").alias("month")).agg(F.count("*").alias("n"))


@query("j1_f2_failure_join", f"""with {X.TELEMETRY}, {X.FAILURES} select model, disk_id, strftime(day, '%Y-%m-%d') as day,
  datediff('day', day, failure_day) as ttf from tel left join fail using (model, disk_id)""")
def j1(spark, sf):
    joined = W.with_failures(X.telemetry(spark, sf), W.earliest_failures(X.failure_tags(spark, sf)), "day")
    return day_text(joined.select("model", "disk_id", "day", "ttf"))


@query("p4_min_length", f"with {X.TELEMETRY} select model, disk_id, count(*) as n from tel group by 1, 2 having count(*) >= 30")
def p4(spark, sf):
    # a device with fewer rows than the window never fills a frame, so its windows vanish
    wins = W.row_windows(X.telemetry(spark, sf), FEATURES, keep_arrays=False)
    return wins.groupBy("model", "disk_id").agg((F.count("*") + 29).alias("n"))


LAB = X.WINDOWS_LEAN


@query("p5_after_failure", f"with {LAB} select model, count(*) as n, count(ttf) as with_ttf, min(ttf) as lowest from lab group by 1")
def p5(spark, sf):
    wins = W.row_windows(X.imputed(spark, sf), FEATURES, keep_arrays=False)
    lab = W.label_windows(wins, W.earliest_failures(X.failure_tags(spark, sf)))
    return lab.groupBy("model").agg(F.count("*").alias("n"), F.count("ttf").alias("with_ttf"), F.min("ttf").alias("lowest"))


@query("p6_label", f"with {LAB} select {WKEY}, ttf, y from lab")
def p6(spark, sf):
    wins = W.row_windows(X.imputed(spark, sf), FEATURES, keep_arrays=False)
    return wkey(W.label_windows(wins, W.earliest_failures(X.failure_tags(spark, sf))), "ttf", "y")


ALL_ROUNDS = X.WINDOWS_ALL_ROUNDS


@query("p7_split", f"with {ALL_ROUNDS} select {WKEY}, month_idx, round, split from win")
def p7(spark, sf):
    return wkey(windows(spark, sf, False, (1, 2, 3)), "month_idx", "round", "split")


@query("a29_window_counts", f"with {ALL_ROUNDS} select model, round, split, y, count(*) as windows from win group by 1, 2, 3, 4")
def a29(spark, sf):
    return W.count_windows(windows(spark, sf, False, (1, 2, 3)))


@query("o1_window_order", f"with {LAB} select model, split, disk_id, strftime(end_day, '%Y-%m-%d') as end_day, row_number() over (partition by model, split order by disk_id, end_day) - 1 as test_index from win")
def o1(spark, sf):
    return W.number_windows(windows(spark, sf, False), ["model", "split"]).select(
        "model", "split", "disk_id", F.col("end_day").cast("string").alias("end_day"), "test_index")


WIN = X.WINDOWS
SPLIT_SUMMARY = """select model, round, split, count(*) as num_windows, max(len(r_5)) as window_days, 4 as num_attributes,
  count(*) filter (where y = 1) as num_failed, count(*) filter (where y = 0) as num_healthy, 1 as valid
from win group by 1, 2, 3"""


@query("s10_split_summary", f"with {WIN} {SPLIT_SUMMARY}")
def s10(spark, sf):
    return WS.summarize_split(windows(spark, sf), FEATURES)


@query("k2_s4_window_store", f"with {X.windows_sql(rounds=(1, 2, 3))} select model, round, split, y, count(*) as n, {', '.join(f'sum(list_sum({c})) as {c}' for c in FEATURES)}, sum(r_241[1]) as first_days from win group by 1, 2, 3, 4")
def k2(spark, sf):
    path = scratch_dir(spark, "windows")
    WS.write_store(X.imputed(spark, sf), windows(spark, sf, False, (1, 2, 3)), path)
    wins = WS.read_store(spark, path, FEATURES)
    return wins.groupBy("model", "round", "split", "y").agg(
        F.count("*").alias("n"), *[F.sum(S.total(F.col(c))).alias(c) for c in FEATURES], F.sum(S.first(F.col("r_241"))).alias("first_days"))


@query("s4_read_split", f"with {WIN} select {WKEY}, y, ttf, {', '.join(f'list_sum({c}) as {c}' for c in FEATURES)} from win where model = 'MB1' and split = 'test'")
def s4(spark, sf):
    path = scratch_dir(spark, "windows")
    WS.write_store(X.imputed(spark, sf), windows(spark, sf, False, (1, 2, 3)), path)
    return wkey(WS.read_store(spark, path, FEATURES, model="MB1", round_id=1, split="test"), "y", "ttf", *[S.total(F.col(c)).alias(c) for c in FEATURES])


@query("k7_w1_w3_incremental_windows", f"""with {X.windows_sql(30)} select model, disk_id, strftime(end_day, '%Y-%m-%d') as end_day,
{', '.join(f'{r6(f"list_sum({c})")} as {c}' for c in FEATURES)}, {', '.join(f'{r6(f"{c}[1]")} as {c}_first' for c in FEATURES)} from roww where n = 30""")
def k7_windows(spark, sf):
    """The telemetry in three batches, each with days late by up to years; windows of the store after the last one."""
    daily = X.telemetry(spark, sf)
    store = I.WindowStore(scratch_dir(spark, "incremental"), tuple(FEATURES))
    I.create(spark, store, daily.schema)
    late = (F.col("disk_id") * 7 + F.unix_date("day")) % 61 == 0
    period = F.when(late | (F.col("day") >= F.lit("2001-01-01").cast("date")), 2).when(F.col("day") >= F.lit("1998-01-01").cast("date"), 1).otherwise(0)
    for batch in range(3):
        I.advance(store, daily.filter(period == batch), batch)
    done = I.finished(spark, store)
    return done.select("model", "disk_id", F.col("end_day").cast("string").alias("end_day"), *[F.round(S.total(F.col(c)), 6).alias(c) for c in FEATURES],
                       *[F.round(F.get(c, F.lit(0)), 6).alias(f"{c}_first") for c in FEATURES])


@query("k7_missing_partitions", f"""with {ALL_ROUNDS}, asked as (select distinct model, round, split from win)
select model, round, split from asked where not (round = 1 and split in ('train', 'val'))""")
def k7(spark, sf):
    wins = windows(spark, sf, False, (1, 2, 3))
    path = scratch_dir(spark, "partial")
    WS.write_windows(wins.filter("round = 1 and split in ('train', 'val')"), path)
    asked = wins.select("model", "round", "split").distinct()
    return WS.missing_partitions(asked, WS.read_split(spark, path), ["model", "round", "split"])


@query("u1_union_daily", f"with {X.TELEMETRY} select model, count(*) as n, {SUMS} from tel group by 1")
def u1(spark, sf):
    # logs of different years carry different attributes; union by name fills the gaps with nulls
    daily = X.telemetry(spark, sf)
    early = daily.filter(F.year("day") < 1998)
    late = daily.filter(F.year("day") >= 1998).select("r_241", "r_197", "r_187", "r_5", "day", "disk_id", "model")
    return feature_sums(early.unionByName(late, allowMissingColumns=True), "model")
