"""Telemetry, failure tags, scores and responses derived from the given tables, and their SQL.

Feature values are whole numbers, so sums over them are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetpulse.operators.windows import SplitRule, impute

FEATURES = ["r_5", "r_187", "r_197", "r_241"]
RULE = SplitRule(last_month=72, val=12, test=24)
GROUPS = {"r_5": "error", "r_187": "error", "r_197": "wear", "r_241": "workload"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_of(disk_id):
    return F.when(F.floor(disk_id / 2) % 2 == 0, "MB1").otherwise("MB2")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows (model, disk_id, day, features) with gaps: lineitem per supplier and ship day."""
    days = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("disk_id"), F.col("l_shipdate").cast("date").alias("day"))
        .agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.count("*").alias("n"),
             F.max("l_extendedprice").alias("p"))
    )
    missing_day = (F.col("disk_id") * 31 + F.unix_date("day")) % 7 == 0
    never = F.col("disk_id") % 10 == 3
    return days.select(
        model_of(F.col("disk_id")).alias("model"), "disk_id", "day",
        F.when(~missing_day, F.col("q").cast("double")).alias("r_5"),
        F.when(~never, F.round(F.col("d") * 100)).alias("r_187"),
        F.col("n").cast("double").alias("r_197"),
        F.floor(F.col("p") / 100).cast("double").alias("r_241"),
    )


TELEMETRY = """
tel as (
  select case when (disk_id // 2) % 2 = 0 then 'MB1' else 'MB2' end as model, disk_id, day,
    case when (disk_id * 31 + datediff('day', date '1970-01-01', day)) % 7 = 0 then null else q end as r_5,
    case when disk_id % 10 = 3 then null else round(d * 100) end as r_187,
    cast(n as double) as r_197, floor(p / 100) as r_241
  from (select l_suppkey as disk_id, cast(l_shipdate as date) as day, sum(l_quantity) as q, max(l_discount) as d,
          count(*) as n, max(l_extendedprice) as p
        from lineitem group by 1, 2)
)"""


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a daily log: ``ds`` as a yyyymmdd number."""
    daily = telemetry(spark, sf_dir)
    return daily.select("disk_id", F.date_format("day", "yyyyMMdd").cast("int").alias("ds"), "model", *FEATURES)


def failure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags (model, disk_id, failure_time as text), several per device."""
    hit = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45) & (F.col("l_discount") >= 0.09) & (
        F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_suppkey") % 2 == 0)
    rows = table(spark, sf_dir, "lineitem").filter(hit)
    return rows.select(model_of(F.col("l_suppkey")).alias("model"), F.col("l_suppkey").alias("disk_id"),
                       F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("failure_time"))


FAILURES = """
fail as (
  select case when (l_suppkey // 2) % 2 = 0 then 'MB1' else 'MB2' end as model, l_suppkey as disk_id,
    min(cast(l_shipdate as date)) as failure_day
  from lineitem
  where l_returnflag = 'R' and l_quantity >= 45 and l_discount >= 0.09 and l_shipdate >= timestamp '1997-01-01'
    and l_suppkey % 2 = 0
  group by 1, 2
)"""


def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute(telemetry(spark, sf_dir), FEATURES)


def _fill(c: str) -> str:
    return (f"coalesce(last_value({c} ignore nulls) over (partition by model, disk_id order by day rows between "
            f"unbounded preceding and current row), first_value({c} ignore nulls) over (partition by model, disk_id "
            f"order by day rows between unbounded preceding and unbounded following)) as {c}")


IMPUTED = TELEMETRY + f""",
filled as (select model, disk_id, day, {', '.join(_fill(c) for c in FEATURES)} from tel),
med as (select model, {', '.join(f'coalesce(quantile_cont({c}, 0.5), 0.0) as m_{c}' for c in FEATURES)}
        from filled group by model),
imp as (select model, disk_id, day, {', '.join(f'coalesce({c}, m_{c}) as {c}' for c in FEATURES)}
        from filled join med using (model))"""

MONTHS = """
months as (select model, month, dense_rank() over (partition by model order by month) as month_idx
  from (select distinct model, date_trunc('month', day) as month from tel))"""


def split_case(round_id: int = 1, idx: str = "month_idx") -> str:
    end = RULE.last_month - (round_id - 1)
    test_from = end - RULE.test + 1
    val_from = test_from - RULE.val
    return (f"case when {idx} between {test_from} and {end} then 'test' when {idx} between {val_from} and "
            f"{test_from - 1} then 'val' when {idx} between 1 and {val_from - 1} then 'train' end")


def windows_sql(size: int = 30, rounds: tuple[int, ...] = (1,), arrays: bool = True) -> str:
    """CTEs up to ``win``: the labelled, split windows."""
    frame = f"over (partition by model, disk_id order by day rows between {size - 1} preceding and current row)"
    cols = "".join(f", list({c}) {frame} as {c}" for c in FEATURES) if arrays else ""
    places = " union all ".join(f"select *, {r} as round, {split_case(r)} as split from lab" for r in rounds)
    return IMPUTED + "," + FAILURES + "," + MONTHS + f""",
roww as (select model, disk_id, day as end_day, count(*) {frame} as n{cols} from imp),
lab as (select w.*, m.month_idx, datediff('day', w.end_day, f.failure_day) as ttf,
    case when datediff('day', w.end_day, f.failure_day) between 0 and 30 then 1 else 0 end as y
  from roww w left join fail f using (model, disk_id)
  join months m on m.model = w.model and m.month = date_trunc('month', w.end_day)
  where n = {size} and (f.failure_day is null or f.failure_day >= w.end_day)),
win as (select * exclude (n) from ({places}) where split is not null)"""


WINDOWS = windows_sql()
WINDOWS_LEAN = windows_sql(arrays=False)
WINDOWS_ALL_ROUNDS = windows_sql(rounds=(1, 2, 3), arrays=False)


def r6(expr: str) -> str:
    """Six decimals without a negative zero."""
    return f"(round({expr}, 6) + 0.0)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text answers made of the assistant turns: JSON, JSON inside text, or no JSON, by conv_id % 3."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    n = F.length("text")
    status = F.when(n % 2 == 1, F.when(n % 3 == 0, "at-risk").otherwise("AT_RISK")).otherwise("HEALTHY")
    risky = n % 2 == 1
    body = F.to_json(F.struct(
        status.alias("status"),
        F.when(n % 5 != 0, F.when(n % 4 == 0, "SERIOUS concern").when(n % 4 == 1, "MEDIUM concern").otherwise("LOW concern")).alias("concern_level"),
        F.when(risky, (n % 45).cast("int")).alias("ttf_days"),
        F.when(risky, F.when(n % 45 < 7, "<7").when(n % 45 <= 30, "7-30").otherwise(">30")).otherwise("NONE").alias("ttf_bucket"),
        F.col("text").alias("explanation"),
        F.array(F.lit("watch the device"), F.concat(F.lit("turn "), F.col("turn"))).alias("recommendations")))
    kind = F.col("conv_id") % 3
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Answer follows. "), body, F.lit("\nThat is all."))).otherwise(F.col("text"))
    return turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("index"), "conv_id", "turn",
        F.when(F.floor(F.col("conv_id") / 2) % 2 == 0, "MB1").otherwise("MB2").alias("dataset"),
        (F.lit(1) + F.floor(F.col("conv_id") / 4) % 3).cast("int").alias("round"),
        F.concat(F.lit("m"), F.floor(F.col("turn") / 2) % 3).alias("method"), F.concat(F.lit("b"), n % 4).alias("backbone"),
        F.when(F.floor(n / 2) % 2 == 1, 1).otherwise(0).alias("true_status"),
        F.when(F.floor(n / 2) % 2 == 1, ((n * 7) % 40 - 2).cast("double")).alias("true_ttf_days"), raw.alias("raw_text"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetpulse.functions.responses import parse_answers

    return parse_answers(answers(spark, sf_dir)).filter("parse_error is null")


ANSWERS = """
ans as (
  select conv_id * 100 + turn as index, conv_id, turn, text, length(text) as n,
    case when (conv_id // 2) % 2 = 0 then 'MB1' else 'MB2' end as dataset, 1 + (conv_id // 4) % 3 as round,
    'm' || (turn // 2) % 3 as method, 'b' || length(text) % 4 as backbone,
    (length(text) // 2) % 2 as true_status,
    case when (length(text) // 2) % 2 = 1 then cast((length(text) * 7) % 40 - 2 as double) end as true_ttf_days
  from conversations where role = 'assistant'),
pred as (
  select *, case when n % 2 = 1 then case when n % 3 = 0 then 'at-risk' else 'AT_RISK' end else 'HEALTHY' end as status_text, n % 2 as pred_status,
    case when n % 5 = 0 then 'LOW concern' when n % 4 = 0 then 'SERIOUS concern' when n % 4 = 1 then 'MEDIUM concern' else 'LOW concern' end as concern_level,
    case when n % 2 = 1 then n % 45 end as pred_ttf_days,
    case when n % 2 = 0 then 'NONE' when n % 45 < 7 then '<7' when n % 45 <= 30 then '7-30' else '>30' end as pred_ttf_bucket
  from ans where conv_id % 3 <> 2)"""

CONF = """
conf as (select method, backbone, dataset, round, count(*) filter (where true_status = 1 and pred_status = 1) as tp,
  count(*) filter (where true_status = 0 and pred_status = 1) as fp, count(*) filter (where true_status = 0 and pred_status = 0) as tn,
  count(*) filter (where true_status = 1 and pred_status = 0) as fn from pred group by all)"""


def div(a: str, b: str) -> str:
    return f"(case when ({b}) <> 0 then ({a}) / ({b})::double else 0.0 end)"


def rates_sql(source: str, keys: str, name: str = "rated") -> str:
    """CTE with precision, recall, f1, f05, fpr, fnr from tp, fp, tn, fn."""
    return f"""{name}_pr as (select *, {div('tp', 'tp + fp')} as precision, {div('tp', 'tp + fn')} as recall from {source}),
{name} as (select {keys}, tp, fp, tn, fn, precision, recall, {div('2 * precision * recall', 'precision + recall')} as f1,
  {div('1.25 * precision * recall', '0.25 * precision + recall')} as f05, {div('fp', 'fp + tn')} as fpr, {div('fn', 'tp + fn')} as fnr from {name}_pr)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, doc_id, score, label): a length score in [0, 1) against the quality label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars").cast("double")
    return docs.select("lang", "doc_id", (n / (n + 1000.0)).alias("score"), F.col("quality").alias("label"))


SCORES = """
scores as (select lang, doc_id, cast(n_chars as double) / (cast(n_chars as double) + 1000.0) as score, quality as label
  from documents join labels using (doc_id))"""


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published-looking table: length cut-offs as methods, P/R/F0.5 rounded to two digits, with supports."""
    from fleetpulse.functions.scalars import round_half_up
    from fleetpulse.operators.metrics import confusion, with_rates

    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    cuts = F.array(*[F.lit(c) for c in (100, 300, 1000, 3000, 10_000_000)])
    rows = docs.select(F.when(F.col("doc_id") % 2 == 0, "MB1").otherwise("MB2").alias("dataset"), "lang", "n_chars",
                       F.col("toxic").alias("true_status"), F.explode(cuts).alias("cut"))
    rows = rows.withColumn("pred_status", (F.col("n_chars") > F.col("cut")).cast("int"))
    rated = with_rates(confusion(rows, ["cut", "lang", "dataset"]))
    return rated.select(
        F.concat(F.lit("len>"), F.col("cut")).alias("method"), F.col("lang").alias("backbone"), "dataset",
        round_half_up(F.col("precision")).alias("p"), round_half_up(F.col("recall")).alias("r"), round_half_up(F.col("f05")).alias("f"),
        (F.col("tp") + F.col("fn")).alias("pos"), (F.col("fp") + F.col("tn")).alias("neg"))


def half_up(x: str) -> str:
    return f"cast(round(cast(cast({x} as varchar) as decimal(28, 20)), 2) as double)"


PUBLISHED = f"""
pubc as (select 'len>' || cut as method, lang as backbone, case when doc_id % 2 = 0 then 'MB1' else 'MB2' end as dataset,
    count(*) filter (where toxic = 1 and n_chars > cut) as tp, count(*) filter (where toxic = 0 and n_chars > cut) as fp,
    count(*) filter (where toxic = 0 and n_chars <= cut) as tn, count(*) filter (where toxic = 1 and n_chars <= cut) as fn
  from documents join labels using (doc_id), (values (100), (300), (1000), (3000), (10000000)) c(cut) group by all),
{rates_sql('pubc', 'method, backbone, dataset', 'pubr')},
pub as (select method, backbone, dataset, {half_up('precision')} as p, {half_up('recall')} as r, {half_up('f05')} as f, cast(tp + fn as bigint) as pos, cast(fp + tn as bigint) as neg from pubr)"""
