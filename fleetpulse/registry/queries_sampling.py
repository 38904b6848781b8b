"""Class-ratio, capped and fixed samples over the whole window table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse import scratch_dir
from fleetpulse.operators import reports as P, sampling as R
from fleetpulse.registry import fixtures as X
from fleetpulse.registry.catalog import query
from fleetpulse.registry.fixtures import r6
from fleetpulse.registry.queries_data import WKEY, windows, wkey
from fleetpulse.session import materialize
from fleetpulse.sources import evaluation_io as E

BY = ["model", "round"]
KEYS = ["disk_id", "end_day"]


def h(seed: int, day: str = "end_day", disk: str = "disk_id") -> str:
    return f"md5('{seed}|' || {disk} || '|' || strftime({day}, '%Y-%m-%d'))"


def sample_sql(quota: str, seed: int, split: str = "test", ctes: str = X.WINDOWS_LEAN) -> str:
    """CTEs up to ``pick``: rows whose hash rank in their class is within the quota."""
    return ctes + f""",
base as (select * from win where split = '{split}'),
cnt as (select model, round, sum(y)::bigint as nf, sum(1 - y)::bigint as nh from base group by 1, 2),
ranked as (select b.*, nf, nh, row_number() over (partition by model, round, y order by {h(seed)}, disk_id, end_day) as rk
  from base b join cnt using (model, round)),
pick as (select * from ranked where rk <= {quota})"""


def split_rows(spark, sf, split="test", rounds=(1,)):
    """Keys and labels of the windows, written once: a draw reads them several times."""
    return materialize(windows(spark, sf, False, rounds).filter(F.col("split") == split), "lean-windows")


def picked(df):
    return wkey(df, "round", "y")


PICK = f"select {WKEY}, round, y from pick"


@query("r1_ratio_sample", f"with {sample_sql('case when y = 1 then nf else least(nh, round_even(nf * 23.0, 0)) end', 2026)} {PICK}")
def r1(spark, sf):
    return picked(R.by_ratio(split_rows(spark, sf), BY, KEYS))


ALL = X.WINDOWS_ALL_ROUNDS
R2 = sample_sql("case when y = 1 then nf else least(nh, round_even(nf * 23.0, 0)) end", 2026, ctes=ALL)


@query("r2_w5_sampled_index", f"""with {R2} select {WKEY}, round, y as true_status,
  case when y = 1 then 'failed' else 'healthy' end as selected_group,
  row_number() over (partition by model, round order by {h(2027)}, disk_id, end_day) as sample_rank from pick""")
def r2(spark, sf):
    index = R.sampled_index(split_rows(spark, sf, rounds=(1, 2, 3)), BY, KEYS)
    return wkey(index, "round", "true_status", "selected_group", "sample_rank")


@query("r2_sampling_summary", f"""with {R2} select model, round, max(nf) as raw_failed, max(nh) as raw_healthy, sum(y)::bigint as selected_failed,
  sum(1 - y)::bigint as selected_healthy, count(*) as selected_total, {r6('sum(1 - y) / sum(y)')} as ratio from pick group by 1, 2""")
def r2s(spark, sf):
    rows = split_rows(spark, sf, rounds=(1, 2, 3))
    out = R.sampling_summary(rows, R.sampled_index(rows, BY, KEYS), BY)
    return out.select(*BY, "raw_failed", "raw_healthy", "selected_failed", "selected_healthy", "selected_total",
                      F.round("selected_healthy_to_failed_ratio", 6).alias("ratio"))


@query("r3_select_modes", f"""with {sample_sql('case when y = 1 then least(nf, 10) else least(nh, round_even(least(nf, 10) * 2.5, 0)) end', 7)}
select 'all' as mode, model, round, count(*) as n, sum(y)::bigint as failed from base group by 2, 3
union all select 'ratio', model, round, count(*), sum(y)::bigint from pick group by 2, 3
union all select 'fixed', model, round, count(*), sum(y)::bigint from pick where y = 1 group by 2, 3""")
def r3(spark, sf):
    rows = split_rows(spark, sf)
    ratio = R.select_for_evaluation(rows, BY, KEYS, "ratio", ratio=2.5, seed=7, max_failed=10)
    fixed = R.select_for_evaluation(rows, BY, KEYS, "fixed", index=ratio.filter("y = 1"))
    parts = [("all", R.select_for_evaluation(rows, BY, KEYS, "all")), ("ratio", ratio), ("fixed", fixed)]
    out = None
    for mode, df in parts:
        part = df.groupBy(*BY).agg(F.count("*").alias("n"), F.sum("y").alias("failed")).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("r4_downsample_train", f"with {sample_sql('least(nf, nh)', 0, 'train')} {PICK}")
def r4(spark, sf):
    return picked(R.one_to_one(split_rows(spark, sf, "train"), BY, KEYS, 0))


TARGET = "greatest(1, round_even(nf * 400.0, 0))"


@query("r5_balanced_ratio", f"""with {sample_sql(f"case when y = 1 then case when nh >= {TARGET} then nf else least(nf, greatest(1, floor(nh / 400.0))) end else case when nh >= {TARGET} then {TARGET} else nh end end", 3, 'train')} {PICK}""")
def r5(spark, sf):
    # 400 healthy per failed is more than the split holds, so the failed side is cut
    return picked(R.balanced(split_rows(spark, sf, "train"), BY, KEYS, 400.0, 3))


@query("r6_capped_groups", """select event_type, event_id, user_id from (
  select *, row_number() over (partition by event_type order by md5('42|' || event_id), event_id) as rk from events) where rk <= 500""")
def r6q(spark, sf):
    return R.capped(X.table(spark, sf, "events"), ["event_type"], ["event_id"], 500).select("event_type", "event_id", "user_id")


@query("r7_window_subsample", f"""with {X.WINDOWS_LEAN} select {WKEY} from (
  select *, row_number() over (partition by model order by {h(42)}, disk_id, end_day) as rk from win where split = 'train') where rk <= 5000""")
def r7(spark, sf):
    return wkey(R.capped(split_rows(spark, sf, "train"), ["model"], KEYS, 5000))


@query("r8_embedding_cap", """select vec_id, label from (
  select *, row_number() over (order by md5('0|' || vec_id), vec_id) as rk from embeddings) where rk <= 300""")
def r8(spark, sf):
    rows = X.table(spark, sf, "embeddings").withColumn("kind", F.lit("attr"))
    return R.capped(rows, ["kind"], ["vec_id"], 300, 0).select("vec_id", "label")


@query("r9_failed_sample", f"with {sample_sql('case when y = 1 then least(nf, 20) else 0 end', 5)} {PICK}")
def r9(spark, sf):
    return picked(R.failed_only(split_rows(spark, sf), BY, KEYS, 20, 5)).orderBy("model", "disk_id", "end_day")


@query("r10_half_and_half", f"""with {sample_sql('case when y = 1 then least(nf, least(100, nf + nh) // 2) else least(nh, least(100, nf + nh) - least(nf, least(100, nf + nh) // 2)) end', 42)} {PICK}""")
def r10(spark, sf):
    return picked(R.half_and_half(split_rows(spark, sf), BY, KEYS, 100))


@query("u2_union_selected", f"with {sample_sql('case when y = 1 then nf else least(nh, round_even(nf * 2.0, 0)) end', 9)} select y, model, count(*) as n, count(distinct disk_id) as disks from pick group by 1, 2")
def u2(spark, sf):
    rows = split_rows(spark, sf)
    chosen = R.by_ratio(rows, BY, KEYS, 2.0, 9)
    both = chosen.filter("y = 1").unionByName(chosen.filter("y = 0"))
    return both.groupBy("y", "model").agg(F.count("*").alias("n"), F.countDistinct("disk_id").alias("disks"))


@query("u6_subset_check", f"with {sample_sql('case when y = 1 then nf else least(nh, round_even(nf * 23.0, 0)) end', 2026)} select sum(y)::bigint as failed, 0 as failed_not_selected, count(*) as selected, count(*) as distinct_selected from pick")
def u6(spark, sf):
    rows = split_rows(spark, sf)
    chosen = R.by_ratio(rows, BY, KEYS)
    lost = rows.filter("y = 1").join(chosen, [*BY, *KEYS], "left_anti").agg(F.count("*").alias("failed_not_selected"))
    counts = chosen.agg(F.sum("y").alias("failed"), F.count("*").alias("selected"),
                        F.countDistinct(*BY, *KEYS).alias("distinct_selected"))
    # both sides are one row by construction
    return counts.withColumn("k", F.lit(1)).join(lost.withColumn("k", F.lit(1)), "k").drop("k")


@query("k3_s5_index_files", f"with {R2} select y as true_status, count(*) as n from pick where model = 'MB2' and round = 2 group by 1")
def k3(spark, sf):
    rows = split_rows(spark, sf, rounds=(1, 2, 3))
    index = R.sampled_index(rows, BY, KEYS)
    path = scratch_dir(spark, "index")
    E.write_csv(index.select(F.col("model").alias("dataset"), "round", F.lit("test").alias("split"),
                             (F.col("disk_id") * 100000 + F.unix_date("end_day")).alias("test_index"), "true_status",
                             "selected_group", "sample_rank", "healthy_per_failed", "seed"), path)
    return E.read_sampled_indices(spark, path, " mb2 ", 2).groupBy("true_status").agg(F.count("*").alias("n"))


@query("a22_support_totals", f"""with {R2}, per as (select model, round, sum(y)::bigint as f, sum(1 - y)::bigint as hh from pick group by 1, 2)
select model as dataset, string_agg(round::varchar, ',' order by round) as rounds, sum(f)::bigint as positives, sum(hh)::bigint as negatives from per group by 1""")
def a22(spark, sf):
    rows = split_rows(spark, sf, rounds=(1, 2, 3))
    summary = R.sampling_summary(rows, R.sampled_index(rows, BY, KEYS), BY).withColumnRenamed("model", "dataset")
    return P.supports(summary).select("dataset", F.array_join(F.col("rounds").cast("array<string>"), ",").alias("rounds"),
                                      "positives", "negatives")
