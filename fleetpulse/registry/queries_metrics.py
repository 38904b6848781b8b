"""Scalar functions, confusion metrics, thresholds, result tables and count reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse import scratch_dir
from fleetpulse.fixed_values import SOURCE_PREDICTIONS, THRESHOLD_GRID
from fleetpulse.functions import responses as RE, scalars as SC
from fleetpulse.operators import metrics as M, reconstruct as RC, reports as P, windows as W
from fleetpulse.operators.ranking import exact_quantiles
from fleetpulse.registry import fixtures as X
from fleetpulse.registry.catalog import query
from fleetpulse.registry.fixtures import CONF, FEATURES, RULE, r6, rates_sql
from fleetpulse.registry.queries_data import LAB, WKEY, windows, wkey
from fleetpulse.sources import evaluation_io as E

RUN = ["method", "backbone", "dataset"]
RATES = ["precision", "recall", "f1", "f05", "fpr", "fnr"]
RATE_SQL = ", ".join(f"{r6(c)} as {c}" for c in RATES)
PRED = X.ANSWERS


def rounded(cols=RATES):
    return [F.round(c, 6).alias(c) for c in cols]


def rates(df, *keys):
    return df.select(*keys, "tp", "fp", "tn", "fn", *rounded())


# ---- scalar functions -------------------------------------------------------------------------

@query("f4_f5_ttf_bucket", f"""with {LAB} select bucket, mid, count(*) as n from (
  select case when ttf is null or ttf < 0 then 'NONE' when ttf < 7 then '<7' when ttf <= 30 then '7-30' else '>30' end as bucket,
    case when ttf is null or ttf < 0 then null when ttf < 7 then 3.5 when ttf <= 30 then 18.5 else 45.0 end::double as mid
  from (select datediff('day', day, failure_day) as ttf from tel left join fail using (model, disk_id))) group by 1, 2""")
def f4(spark, sf):
    rows = W.with_failures(X.telemetry(spark, sf), W.earliest_failures(X.failure_tags(spark, sf)), "day")
    b = rows.select(SC.ttf_bucket(F.col("ttf")).alias("bucket"))
    return b.groupBy("bucket", SC.bucket_midpoint(F.col("bucket")).alias("mid")).agg(F.count("*").alias("n"))


@query("f6_status_words", """select word, count(*) as n, max(case when upper(word) like '%RISK%' then 1 else 0 end) as risk,
  max(case when upper(word) like '%RISK%' or upper(word) like '%FAIL%' then 1 else 0 end) as risk_or_fail,
  max(case when upper(word) like '%RISK%' or upper(word) like '%FAIL%' or trim(word) = '1' then 1 else 0 end) as judge from (
  select case o_orderkey % 7 when 0 then 'at-risk' when 1 then ' AT_RISK ' when 2 then 'Healthy' when 3 then 'failed' when 4 then '1'
    when 5 then '0' else o_orderpriority end as word from orders) group by 1""")
def f6(spark, sf):
    k = F.col("o_orderkey") % 7
    word = (F.when(k == 0, "at-risk").when(k == 1, " AT_RISK ").when(k == 2, "Healthy").when(k == 3, "failed")
            .when(k == 4, "1").when(k == 5, "0").otherwise(F.col("o_orderpriority")))
    rows = X.table(spark, sf, "orders").select(word.alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"), *[
        F.max(SC.status_flag(F.col("word"), v)).alias(v) for v in ("risk", "risk_or_fail", "judge")])


@query("f7_normalize_bucket", f"""with {PRED} select case when pred_ttf_bucket = 'NONE' then 'NO_FAILURE' else pred_ttf_bucket end as bucket, count(*) as n from pred group by 1
union all select 'NO_FAILURE', count(*) from ans where conv_id % 3 = 2""")
def f7(spark, sf):
    parsed = RE.parse_answers(X.answers(spark, sf))
    good = parsed.filter("parse_error is null").groupBy(SC.normalize_bucket(F.col("pred_ttf_bucket")).alias("bucket")).agg(F.count("*").alias("n"))
    bad = parsed.filter("parse_error is not null").groupBy(SC.normalize_bucket(F.col("pred_ttf_bucket")).alias("bucket")).agg(F.count("*").alias("n"))
    return good.unionByName(bad)


@query("f8_concern_rank", f"with {PRED} select concern_level, case when concern_level like 'SERIOUS%' then 2 when concern_level like 'LOW%' then 0 else 1 end as rank, count(*) as n from pred group by 1, 2")
def f8(spark, sf):
    return X.predictions(spark, sf).groupBy("concern_level", SC.concern_rank(F.col("concern_level")).alias("rank")).agg(F.count("*").alias("n"))


@query("f9_f17_names", """select case when o_orderkey % 5 < 3 then '-' else trim(o_orderpriority) end as backbone,
  replace(replace(o_orderpriority || '/' || o_orderstatus, '/', '_'), ' ', '_') as safe, count(*) as n from orders group by 1, 2""")
def f9(spark, sf):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 1, "  ").when(k == 2, "NaN").when(k > 2, F.concat(F.lit(" "), F.col("o_orderpriority")))
    rows = X.table(spark, sf, "orders")
    return rows.groupBy(SC.normalize_backbone(raw).alias("backbone"),
                        SC.safe_name(F.concat_ws("/", "o_orderpriority", "o_orderstatus")).alias("safe")).agg(F.count("*").alias("n"))


@query("f10_b5_mentions", f"""with {PRED} select index, case when lower(t) like '%r\\_187%' escape '\\' or lower(t) like '%reported uncorrectable%' or lower(t) like '%uncorrectable error%' then 1 else 0 end as r_187,
  case when lower(t) like '%r\\_5%' escape '\\' or lower(t) like '%reallocated sector%' or lower(t) like '%re-allocated sector%' then 1 else 0 end as r_5
from (select index, text || case n % 4 when 0 then ' The Uncorrectable ERROR count grows.' when 1 then ' see r_5' when 2 then ' r_1' else '' end as t from ans)""")
def f10(spark, sf):
    n = F.length("text")
    rows = X.table(spark, sf, "conversations").filter("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("index"),
        F.concat("text", F.when(n % 4 == 0, " The Uncorrectable ERROR count grows.").when(n % 4 == 1, " see r_5")
                 .when(n % 4 == 2, " r_1").otherwise("")).alias("t"))
    return rows.select("index", *[RE.attr_mentioned(F.col("t"), F.lit(a)).cast("int").alias(a) for a in ("r_5", "r_187")])


@query("f11_ensure_mentions", f"""with {PRED} select index, case when n % 3 = 0 then t || ' r_5 is high.' else
  case when rtrim(t, chr(32) || chr(10) || chr(9) || chr(13)) like '%.' then t || clause else rtrim(t, chr(32) || chr(10) || chr(9) || chr(13)) || '. ' || clause end end as fixed
from (select index, n, text as t, ' Key SMART attributes involved: ' || case when n % 3 = 1 then 'r_5: rises fast' else 'r_5' end || '.' as clause from ans)""")
def f11(spark, sf):
    n = F.length("text")
    rows = X.table(spark, sf, "conversations").filter("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("index"),
        F.when(n % 3 == 0, F.concat("text", F.lit(" r_5 is high."))).otherwise(F.col("text")).alias("t"),
        F.when(n % 3 == 1, "Window\n- r_5: rises fast\n- r_9: flat").otherwise("Window\n- r_9: flat").alias("summary"))
    return rows.select("index", RE.ensure_mentions(F.col("t"), F.col("summary"), ["r_5"]).alias("fixed"))


@query("f12_f14_t7_parse_answers", f"""with {PRED} select index, null as parse_error, status_text, pred_status, concern_level, pred_ttf_days, pred_ttf_bucket, text as explanation,
  'watch the device || turn ' || turn as recommendations from pred
union all select index, case when regexp_matches(text, '(?s)\\{{.*\\}}') then 'bad JSON' else 'no JSON object' end, null, null, null, null, null, null, null from ans where conv_id % 3 = 2""")
def f12(spark, sf):
    p = RE.parse_answers(X.answers(spark, sf))
    return p.select("index", "parse_error", "status_text", "pred_status", "concern_level", "pred_ttf_days", "pred_ttf_bucket",
                    "explanation", RE.join_recommendations(F.col("recommendations")).alias("recommendations"))


@query("f13_free_text_status", f"""with {PRED} select index, case n % 4 when 0 then 'AT_RISK' when 1 then 'HEALTHY' when 2 then null else 'AT_RISK' end as status from ans""")
def f13(spark, sf):
    n = F.length("text")
    end = (F.when(n % 4 == 0, "\nSo the drive is at risk.\n\n").when(n % 4 == 1, "\nStatus is HEALTHY")
           .when(n % 4 == 2, "\nthe drive is healthy\na\nb\nc\nd\ne").otherwise("\nthe drive is healthy, or the drive is AT_RISK\na\nb"))
    rows = X.table(spark, sf, "conversations").filter("role = 'assistant'")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("index"),
                       RE.status_from_free_text(F.concat("text", end)).alias("status"))


@query("f15_ttf_number", """select props as raw, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k, null::int as broken, count(*) as n from events group by 1, 2""")
def f15(spark, sf):
    k = F.get_json_object("props", "$.k")
    rows = X.table(spark, sf, "events").groupBy("props").agg(F.count("*").alias("n"))
    return rows.select(F.col("props").alias("raw"), RE.ttf_number(F.concat(k, F.lit(".7"))).alias("k"),
                       RE.ttf_number(F.concat(k, F.lit(" days"))).alias("broken"), "n")


GROUP_SQL = """case when regexp_matches(nm, 'error|err|uncorr|realloc|re-alloc|pending|crc|timeout|fail|bad_block|bad block') then 'error'
  when regexp_matches(nm, 'wear|erase|pe_cycle|life|program|nand_wr|nand writes') then 'wear'
  when regexp_matches(nm, 'read|write|throughput|iops|bandwidth|util|queue|qdepth|latency') then 'workload' else 'other' end"""


@query("f18_feature_group", f"""select name, {GROUP_SQL.replace('nm', 'lower(name)')} as grp, n from (
  select case p_partkey % 6 when 0 then 'Uncorrectable_Error_' when 1 then 'Wear_Leveling_' when 2 then 'Host_Writes_' when 3 then 'r_' when 4 then 'CRC_read_' else 'temp_' end || p_brand as name,
    count(*) as n from part group by 1)""")
def f18(spark, sf):
    k = F.col("p_partkey") % 6
    head = (F.when(k == 0, "Uncorrectable_Error_").when(k == 1, "Wear_Leveling_").when(k == 2, "Host_Writes_").when(k == 3, "r_")
            .when(k == 4, "CRC_read_").otherwise("temp_"))
    rows = X.table(spark, sf, "part").groupBy(F.concat(head, "p_brand").alias("name")).agg(F.count("*").alias("n"))
    return rows.select("name", SC.feature_group(F.col("name")).alias("grp"), "n")


# ---- confusion and rates ----------------------------------------------------------------------

@query("a12_confusion", f"with {PRED}, {CONF} select * from conf")
def a12(spark, sf):
    return M.confusion(X.predictions(spark, sf), [*RUN, "round"])


@query("a13_f21_f22_status_metrics", f"with {PRED}, {CONF}, {rates_sql('conf', 'method, backbone, dataset, round')} select method, backbone, dataset, round, tp, fp, tn, fn, {RATE_SQL} from rated")
def a13(spark, sf):
    return rates(M.with_rates(M.confusion(X.predictions(spark, sf), [*RUN, "round"])), *RUN, "round")


SUMMED = f"summed as (select method, backbone, dataset, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(tn)::bigint as tn, sum(fn)::bigint as fn, count(distinct round) as rounds from conf group by 1, 2, 3), {rates_sql('summed', 'method, backbone, dataset, rounds', 'sr')}"


def summed(spark, sf, required=None):
    return M.sum_rounds(M.confusion(X.predictions(spark, sf), [*RUN, "round"]), RUN, required)


@query("a14_sum_rounds", f"with {PRED}, {CONF}, {SUMMED} select method, backbone, dataset, tp, fp, tn, fn, {RATE_SQL} from sr where rounds = 3")
def a14(spark, sf):
    return rates(summed(spark, sf, 3), *RUN)


def eps(d: str) -> str:
    return f"({d} + 1e-9)"


@query("f23_eps_f1", f"with {PRED}, {CONF} select method, backbone, dataset, round, {r6('2 * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9)) / ((tp / (tp + fp + 1e-9)) + (tp / (tp + fn + 1e-9)) + 1e-9)')} as f1 from conf")
def f23(spark, sf):
    c = M.confusion(X.predictions(spark, sf), [*RUN, "round"])
    return c.select(*RUN, "round", F.round(SC.eps_f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))


@query("f24_round_half_up", "select l_orderkey, l_linenumber, count(*) as n, min(cast(round(cast(cast(l_discount * 0.5 as varchar) as decimal(20, 12)), 2) as double)) as half from lineitem group by 1, 2")
def f24(spark, sf):
    rows = X.table(spark, sf, "lineitem").withColumn("half", SC.round_half_up(F.col("l_discount") * 0.5))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("half").alias("half"))


@query("f25_assumed_ratio_fpr", f"with {PRED}, {CONF}, {SUMMED} select method, backbone, dataset, {r6('case when precision > 0 and recall > 0 then greatest(0.0, recall * (1 / precision - 1) / 23.0) else 0.0 end')} as fpr from sr")
def f25(spark, sf):
    s = summed(spark, sf)
    return s.select(*RUN, F.round(SC.assumed_ratio_fpr(F.col("precision"), F.col("recall"), 23.0), 6).alias("fpr"))


USABLE = """
usable as (select *, case when true_ttf_days < 7 then '<7' when true_ttf_days <= 30 then '7-30' else '>30' end as tb,
  abs(true_ttf_days - case pred_ttf_bucket when '<7' then 3.5 when '7-30' then 18.5 else 45.0 end) as err
  from pred where true_status = 1 and pred_status = 1 and pred_ttf_bucket <> 'NONE' and true_ttf_days >= 0)"""


@query("a15_a16_p11_ttf_metrics", f"""with {PRED}, {USABLE},
cells as (select dataset, b, count(*) filter (where tb = b and pred_ttf_bucket = b) as tp, count(*) filter (where tb <> b and pred_ttf_bucket = b) as fp,
  count(*) filter (where tb = b and pred_ttf_bucket <> b) as fn from usable, (values ('<7'), ('7-30'), ('>30')) v(b) group by 1, 2),
f as (select dataset, avg({X.div('2 * tp', '2 * tp + fp + fn')}) as macro_f1 from cells where tp + fn > 0 group by 1)
select dataset, count(*) as n, {r6('max(macro_f1)')} as macro_f1, {r6('avg(err)')} as bmae, {r6('avg(case when err <= 5 then 1.0 else 0.0 end)')} as cov_pm5
from usable join f using (dataset) group by 1""")
def a15(spark, sf):
    m = M.ttf_metrics(E.true_positive_details(X.predictions(spark, sf), ("dataset",)), ["dataset"])
    return m.select("dataset", "n", *rounded(["macro_f1", "bmae", "cov_pm5"]))


SHARED = PRED.replace("pred as (", "single as (", 1) + """,
pred as (select * exclude (index, dataset, backbone), index // 7 as index, dataset, backbone from single)"""


def shared_indices(spark, sf):
    """Predictions whose indices repeat across backbones, datasets and rounds, as those of real runs do."""
    return X.predictions(spark, sf).withColumn("index", F.floor(F.col("index") / 7).cast("bigint"))


@query("ttf_table_shared_indices", f"""with {SHARED}, {USABLE},
cells as (select backbone, dataset, b, count(*) filter (where tb = b and pred_ttf_bucket = b) as tp, count(*) filter (where tb <> b and pred_ttf_bucket = b) as fp,
  count(*) filter (where tb = b and pred_ttf_bucket <> b) as fn from usable, (values ('<7'), ('7-30'), ('>30')) v(b) group by 1, 2, 3),
f as (select backbone, dataset, avg({X.div('2 * tp', '2 * tp + fp + fn')}) as macro_f1 from cells where tp + fn > 0 group by 1, 2)
select backbone, dataset, count(*) as n, {r6('max(macro_f1)')} as macro_f1, {r6('avg(err)')} as bmae, {r6('avg(case when err <= 5 then 1.0 else 0.0 end)')} as cov_pm5
from usable join f using (backbone, dataset) group by 1, 2""")
def ttf_shared(spark, sf):
    from fleetpulse.plans.evaluation import ttf_table

    m = ttf_table(shared_indices(spark, sf))
    return m.select("backbone", "dataset", "n", *rounded(["macro_f1", "bmae", "cov_pm5"]))


@query("status_table_all_rounds", f"""with {SHARED.replace("from single)", "from single where not (method = 'm1' and dataset = 'MB2' and round = 2))")}, {CONF}, {SUMMED},
runs as (select distinct method, backbone from pred)
select runs.method, runs.backbone, {", ".join(f"{r6(f'{d}.{c}')} as {d.lower()}_{c}" for d in ("MB1", "MB2") for c in ("precision", "recall", "f05"))}
from runs left join sr MB1 on MB1.method = runs.method and MB1.backbone = runs.backbone and MB1.dataset = 'MB1' and MB1.rounds = 3
left join sr MB2 on MB2.method = runs.method and MB2.backbone = runs.backbone and MB2.dataset = 'MB2' and MB2.rounds = 3""")
def status_all_rounds(spark, sf):
    from fleetpulse.plans.evaluation import status_table

    rows = shared_indices(spark, sf).filter("not (method = 'm1' and dataset = 'MB2' and round = 2)")
    every = rows.select("dataset", "round", F.col("index").alias("test_index"))
    t = status_table(rows, ["MB1", "MB2"], 3, every)
    return t.select("method", "backbone", *rounded([f"{d}_{c}" for d in ("mb1", "mb2") for c in ("precision", "recall", "f05")]))


@query("m9_ttf_error", f"with {PRED} select dataset, {r6('avg((pred_ttf_days - true_ttf_days) * (pred_ttf_days - true_ttf_days))')} as mse, {r6('avg(abs(pred_ttf_days - true_ttf_days))')} as mae, count(*) as n_examples from pred where pred_ttf_days is not null and true_ttf_days is not null group by 1")
def m9(spark, sf):
    e = M.ttf_error(X.predictions(spark, sf), ["dataset"])
    return e.select("dataset", *rounded(["mse", "mae"]), "n_examples")


@query("p10_true_positives", f"with {PRED} select index as idx, true_status as status_true, status_text as status_pred, true_ttf_days as ttf_true, pred_ttf_days as ttf_days_pred, pred_ttf_bucket as ttf_bucket_pred, 'watch the device || turn ' || turn as recommendations, text as explanation from pred where true_status = 1 and pred_status = 1")
def p10(spark, sf):
    return E.true_positive_details(X.predictions(spark, sf)).drop("ttf_bucket_midpoint")


@query("p8_class_mask", f"with {X.SCORES} select lang, label, count(*) as n, {r6('avg(score)')} as mean_score from scores where label in (0, 1) group by 1, 2")
def p8(spark, sf):
    rows = X.scores(spark, sf).filter(F.col("label").isin(0, 1))
    return rows.groupBy("lang", "label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


# ---- thresholds -------------------------------------------------------------------------------

GRID_VALUES = ", ".join(f"({t!r}::double)" for t in THRESHOLD_GRID)
GRID = X.SCORES + f""",
gc as (select lang, thr, count(*) filter (where label = 1 and score >= thr) as tp, count(*) filter (where label = 0 and score >= thr) as fp,
  count(*) filter (where label = 0 and score < thr) as tn, count(*) filter (where label = 1 and score < thr) as fn
  from scores, (values {GRID_VALUES}) g(thr) group by 1, 2),
{rates_sql('gc', 'lang, thr', 'gr')}"""


@query("m1_grid_scores", f"with {GRID} select lang, {r6('thr')} as thr, tp, fp, tn, fn, {RATE_SQL} from gr")
def m1g(spark, sf):
    return rates(M.grid_scores(X.scores(spark, sf), ["lang"], "score", "label").withColumn("thr", F.round("thr", 6)), "lang", "thr")


PICKED = ["thr", "precision", "recall", "f1"]
PICKED_SQL = ", ".join(f"{r6(c)} as {c}" for c in PICKED)


@query("m1_best_threshold", f"with {GRID} select lang, {PICKED_SQL} from (select *, row_number() over (partition by lang order by f1 desc, thr) as rk from gr) where rk = 1")
def m1(spark, sf):
    b = M.best_f1(M.grid_scores(X.scores(spark, sf), ["lang"], "score", "label"), ["lang"])
    return b.select("lang", *rounded(PICKED))


@query("m2_best_precision", f"with {GRID} select lang, {PICKED_SQL} from (select *, row_number() over (partition by lang order by case when recall > 0 then 1 else 0 end desc, case when recall > 0 then precision else f1 end desc, thr) as rk from gr) where rk = 1")
def m2(spark, sf):
    b = M.best_precision(M.grid_scores(X.scores(spark, sf), ["lang"], "score", "label"), ["lang"])
    return b.select("lang", *rounded(PICKED))


CURVE = X.SCORES + """,
tot as (select lang, sum(label) as p from scores group by 1),
pc as (select lang, score as thr, sum(sum(label)) over (partition by lang order by score desc) as tp, sum(sum(1 - label)) over (partition by lang order by score desc) as fp from scores group by 1, 2),
pf as (select lang, thr, 2.0 * tp / (p + tp + fp) as f1, row_number() over (partition by lang order by 2.0 * tp / (p + tp + fp) desc, thr) as rk from pc join tot using (lang))"""


@query("m3_curve_threshold", f"with {CURVE} select lang, {r6('thr')} as thr, {r6('f1')} as f1 from pf where rk = 1")
def m3(spark, sf):
    t = M.curve_threshold(X.scores(spark, sf), ["lang"], "score", "label")
    return t.select("lang", *rounded(["thr", "f1"]))


@query("m5_evaluate_split", f"""with {X.SCORES}, c as (select lang, count(*) filter (where label = 1 and score >= 0.3) as tp, count(*) filter (where label = 0 and score >= 0.3) as fp,
  count(*) filter (where label = 0 and score < 0.3) as tn, count(*) filter (where label = 1 and score < 0.3) as fn from scores group by 1),
r as (select lang, '1' as cls, {X.div('tp', 'tp + fp')} as precision, {X.div('tp', 'tp + fn')} as recall, {X.div('2 * tp', '2 * tp + fp + fn')} as f1, tp + fn as support from c
  union all select lang, '0', {X.div('tn', 'tn + fn')}, {X.div('tn', 'tn + fp')}, {X.div('2 * tn', '2 * tn + fp + fn')}, tn + fp from c)
select lang, cls, {r6('precision')} as precision, {r6('recall')} as recall, {r6('f1')} as f1, support from (
  select * from r union all select lang, 'macro', avg(precision), avg(recall), avg(f1), sum(support)::bigint from r group by 1
  union all select lang, 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::bigint from r group by 1)""")
def m5(spark, sf):
    pred = X.scores(spark, sf).withColumn("pred", (F.col("score") >= 0.3).cast("int"))
    return M.class_report(pred, ["lang"], "label", "pred").select("lang", "cls", *rounded(["precision", "recall", "f1"]), "support")


@query("a10_exact_quantiles", f"""with {X.SCORES}, q as (select lang, unnest([0.9, 0.95, 0.995]) as q, unnest([quantile_cont(score, 0.9), quantile_cont(score, 0.95), quantile_cont(score, 0.995)]) as v from scores group by 1)
select lang, {r6('q::double')} as q, {r6('v')} as value from q""")
def a10(spark, sf):
    q = exact_quantiles(X.scores(spark, sf), ["lang"], "score", [0.9, 0.95, 0.995])
    return q.select("lang", F.round("q", 6).alias("q"), F.round("quantile", 6).alias("value"))


# ---- result tables ----------------------------------------------------------------------------

DATASETS = ["MB1", "MB2"]
WIDE = ["precision", "recall", "f05", "fpr", "fnr"]
WIDE_COLS = [f"{d.lower()}_{m}" for d in DATASETS for m in WIDE]


@query("u5_wide_table", f"with {PRED}, {CONF}, {SUMMED} select method, backbone, {', '.join(f'max(case when dataset = {chr(39)}{d}{chr(39)} then {r6(m)} end) as {d.lower()}_{m}' for d in DATASETS for m in WIDE)} from sr group by 1, 2")
def u5(spark, sf):
    wide = P.to_wide(summed(spark, sf), ["method", "backbone"], DATASETS)
    return wide.select("method", "backbone", *rounded(WIDE_COLS))


@query("u4_p12_long_table", f"with {PRED}, {CONF}, {SUMMED} select method, backbone, dataset, {', '.join(f'{r6(m)} as {m}' for m in WIDE)} from sr")
def u4(spark, sf):
    wide = P.to_wide(summed(spark, sf), ["method", "backbone"], DATASETS)
    return P.to_long(wide, ["method", "backbone"], DATASETS).select(*RUN, *rounded(WIDE))


@query("j12_result_grid", f"""with {PRED}, {CONF}, g as (select * from (values ('m0'), ('m1'), ('m2'), ('m3')) m(method), (values ('b0'), ('b1'), ('b2'), ('b3')) b(backbone),
  (values ('MB1'), ('MB2')) d(dataset), (values (1), (2), (3)) r(round)) select method, backbone, dataset, round, tp, fp from g left join conf using (method, backbone, dataset, round)""")
def j12(spark, sf):
    c = M.confusion(X.predictions(spark, sf), [*RUN, "round"])
    wanted = P.grid(spark, method=["m0", "m1", "m2", "m3"], backbone=["b0", "b1", "b2", "b3"], dataset=DATASETS, round=[1, 2, 3])
    return P.on_grid(c, wanted).select(*RUN, "round", "tp", "fp")


@query("p13_keep_methods", f"with {PRED}, {CONF}, {SUMMED} select method, backbone, dataset, tp, fp, tn, fn from sr where method in ('m0', 'm2') and backbone in ('b1', 'b3')")
def p13(spark, sf):
    return P.keep(summed(spark, sf), ["m0", "m2"], ["b1", "b3"]).select(*RUN, "tp", "fp", "tn", "fn")


@query("a30_best_row", f"with {PRED}, {CONF}, {SUMMED} select dataset, method, backbone, {r6('f05')} as f05 from (select *, row_number() over (partition by dataset order by f05 desc, method, backbone) as rk from sr) where rk = 1")
def a30(spark, sf):
    return P.best_row(summed(spark, sf), ["dataset"], "f05", ["method", "backbone"]).select("dataset", "method", "backbone", *rounded(["f05"]))


@query("o5_sorted_results", f"with {PRED}, {CONF}, {SUMMED} select method, backbone, dataset, tp, fp from sr order by dataset, method, backbone")
def o5(spark, sf):
    return summed(spark, sf).orderBy("dataset", "method", "backbone").select(*RUN, "tp", "fp")


INDEX_SQL = """idx as (select index, dataset, round from ans where n % 5 <> 0)"""


@query("j3_s6_predictions_in_index", f"with {PRED}, {INDEX_SQL}, {CONF.replace('from pred', 'from pred semi join idx using (index, dataset, round)')} select method, backbone, dataset, round, tp, fp, tn, fn from conf")
def j3(spark, sf):
    path = scratch_dir(spark, "predictions")
    E.write_predictions(prediction_records(spark, sf), path)
    kept = E.read_predictions(spark, path).join(index_rows(spark, sf), ["index", "dataset", "round"], "left_semi")
    return M.confusion(kept, [*RUN, "round"])


def index_rows(spark, sf):
    turns = X.table(spark, sf, "conversations").filter("role = 'assistant'")
    ids = turns.filter(F.length("text") % 5 != 0).select((F.col("conv_id") * 100 + F.col("turn")).alias("index"))
    return X.answers(spark, sf).select("index", "dataset", "round").join(ids, "index", "left_semi")


def prediction_records(spark, sf):
    p = X.predictions(spark, sf)
    return p.select("index", F.col("dataset").alias("dataset_name"), F.lit("").alias("summary"), "true_status", "pred_status",
                    "true_ttf_days", F.col("pred_ttf_days").cast("string").alias("pred_ttf_days"), "pred_ttf_bucket",
                    "concern_level", "explanation", "recommendations", F.col("raw_text").alias("raw_response"),
                    "method", "backbone", "dataset", "round")


@query("j8_labels_and_ttf", f"with {PRED} select index, p.pred_status, a.true_status, a.true_ttf_days from pred p join ans a using (index)")
def j8(spark, sf):
    pred = X.predictions(spark, sf).select("index", "pred_status")
    truth = X.answers(spark, sf).select("index", "true_status", "true_ttf_days")
    return pred.join(truth, "index", "left")


@query("k6_s7_run_tree", f"with {PRED}, {CONF}, {rates_sql('conf', 'method, backbone, dataset, round')} select method, backbone, dataset, round, tp, fp, tn, fn, {r6('f05')} as f05 from rated")
def k6(spark, sf):
    doc = E.metrics_document(M.with_rates(M.confusion(X.predictions(spark, sf), [*RUN, "round"])))
    root = scratch_dir(spark, "runs")
    named = doc.withColumn("file", F.concat_ws("_", "dataset", F.concat(F.lit("round"), "round"), F.lit("metrics.json")))
    # folders root/method/backbone/DATASET_roundN_metrics.json hold one JSON record each
    named.repartition("method", "backbone", "file").select("classification", F.col("method").alias("m"), F.col("backbone").alias("b"), "file").write.partitionBy("m", "b", "file").json(root)
    tree = spark.read.schema("classification struct<tp:long,fp:long,tn:long,fn:long,f05:double>").option("recursiveFileLookup", True).json(root)
    path = F.col("_metadata.file_path")
    part = tree.select("classification.*", *[F.regexp_extract(path, f"/{k}=([^/]+)/", 1).alias(n) for k, n in (("m", "method"), ("b", "backbone"))],
                       F.regexp_extract(path, "/file=([A-Z0-9]+)_round", 1).alias("dataset"),
                       F.regexp_extract(path, "_round([0-9]+)_", 1).cast("int").alias("round"))
    return part.select(*RUN, "round", "tp", "fp", "tn", "fn", F.round("f05", 6).alias("f05"))


@query("k6_s9_result_csv", f"with {PRED} select index as idx, true_status as status_true, pred_ttf_bucket as ttf_bucket_pred, text as explanation from pred where true_status = 1 and pred_status = 1")
def s9(spark, sf):
    path = scratch_dir(spark, "tp")
    E.write_csv(E.true_positive_details(X.predictions(spark, sf)), path)
    schema = "idx long, status_true int, status_pred string, ttf_true double, ttf_days_pred int, ttf_bucket_pred string, ttf_bucket_midpoint double, explanation string, recommendations string"
    return E.read_csv(spark, path, schema).select("idx", "status_true", "ttf_bucket_pred", "explanation")


# ---- reconstruction ---------------------------------------------------------------------------

PUB = X.PUBLISHED
CAND = PUB + f""",
tps as (select pub.*, unnest(range(0, pos + 1)) as tp from pub),
tpk as (select * from tps where {X.half_up(X.div('tp', 'pos'))} = r),
cnd as (select *, unnest(range(0, neg + 1)) as fp from tpk where not (p = 0 and r = 0 and f = 0) and (p > 0 or tp = 0)),
cm as (select *, {X.div('tp', 'tp + fp')} as cp, {X.div('tp', 'pos')} as cr from cnd where p > 0 or fp = 0),
cf as (select *, {X.div('1.25 * cp * cr', '0.25 * cp + cr')} as cfm from cm),
ok as (select *, abs(cp - p) + abs(cr - r) + abs(cfm - f) as err from cf where {X.half_up('cp')} = p and {X.half_up('cr')} = r and {X.half_up('cfm')} = f
  and (p - 0.005 <= 0 or fp <= greatest(0, floor(tp / (p - 0.005) - tp - 1e-12))))"""


@query("j10_m7_candidates", f"with {CAND} select method, backbone, dataset, count(*) as candidate_count, {r6('min(fp / neg)')} as fpr_lower, {r6('max(fp / neg)')} as fpr_upper from ok group by 1, 2, 3")
def j10(spark, sf):
    d = RC.reconstruct(X.published(spark, sf), RUN).filter("candidate_count > 0 and not (p = 0 and r = 0 and f = 0)")
    return d.select(*RUN, "candidate_count", *rounded(["fpr_lower", "fpr_upper"]))


BEST = CAND + """,
zero as (select method, backbone, dataset, 0 as tp, least(neg, greatest(1, round_even(neg * 0.01, 0)))::bigint as fp, pos, neg from pub where p = 0 and r = 0 and f = 0),
best as (select method, backbone, dataset, tp, fp, pos, neg from (select *, row_number() over (partition by method, backbone, dataset order by round(err, 12), tp + fp, fp) as rk from ok) where rk = 1
  union all select * from zero
  union all select method, backbone, dataset, tp, case when p <= 0 then greatest(1, round_even(neg * 0.01, 0)) else greatest(0, least(neg, round_even(tp * (1 / p - 1), 0))) end, pos, neg
  from (select *, greatest(0, least(pos, round_even(r * pos, 0))) as tp from pub where not (p = 0 and r = 0 and f = 0)) anti join ok using (method, backbone, dataset))"""


@query("m6_o6_reconstruct", f"with {BEST} select method, backbone, dataset, tp::bigint as tp, fp::bigint as fp, (neg - fp)::bigint as tn, (pos - tp)::bigint as fn from best")
def m6(spark, sf):
    return RC.reconstruct(X.published(spark, sf), RUN).select(*RUN, "tp", "fp", "tn", "fn")


@query("m8_derived_table", f"""with {BEST}, c as (select method, backbone, dataset, tp, fp, tn, fn from pubc where backbone = 'en'), b as (select *, case when (method, dataset) in (select (method, dataset) from c) and backbone = 'en' then 1 else 0 end as measured from best)
select b.method, b.backbone, b.dataset, coalesce(c.tp, b.tp)::bigint as tp, coalesce(c.fp, b.fp)::bigint as fp, {r6('coalesce(c.fp, b.fp) / b.neg')} as fpr, {r6(X.div('b.pos - coalesce(c.tp, b.tp)', 'b.pos'))} as fnr,
  case when c.tp is not null then 1 else 0 end as measured from b left join c using (method, backbone, dataset)""")
def m8(spark, sf):
    from fleetpulse.operators.metrics import confusion

    rebuilt = RC.reconstruct(X.published(spark, sf), RUN)
    docs = X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id").filter("lang = 'en'")
    rows = docs.select(F.when(F.col("doc_id") % 2 == 0, "MB1").otherwise("MB2").alias("dataset"), F.col("lang").alias("backbone"),
                       "n_chars", F.col("toxic").alias("true_status"), F.explode(F.array(*[F.lit(c) for c in (100, 300, 1000, 3000, 10_000_000)])).alias("cut"))
    pred = rows.select("*", F.concat(F.lit("len>"), F.col("cut")).alias("method"), (F.col("n_chars") > F.col("cut")).cast("int").alias("pred_status"))
    out = RC.prefer_predictions(confusion(pred, RUN), rebuilt, RUN, SOURCE_PREDICTIONS)
    return out.select(*RUN, "tp", "fp", *rounded(["fpr", "fnr"]), (F.col("source") == SOURCE_PREDICTIONS).cast("int").alias("measured"))


@query("a27_ambiguity", f"""with {CAND}, g as (select method, backbone, dataset, count(*) as n, max(fp / neg) - min(fp / neg) as span from ok group by 1, 2, 3)
select (select count(*) from pub) as row_count, (select count(*) from g where n > 1) as ambiguous_row_count, {r6('coalesce((select max(span) from g where n > 1), 0.0)')} as max_fpr_span""")
def a27(spark, sf):
    s = RC.ambiguity_summary(RC.reconstruct(X.published(spark, sf), RUN, zero_row_fpr=None))
    return s.select("row_count", "ambiguous_row_count", F.round("max_fpr_span", 6).alias("max_fpr_span"))


@query("a28_audit", f"with {PUB} select count(*) as n, 0.0::double as fnr_diff, 0.0::double as fpr_diff from pub")
def a28(spark, sf):
    d = RC.reconstruct(X.published(spark, sf), RUN)
    a = RC.audit(d.filter("pos > 0"))
    n = d.agg(F.count("*").alias("n"))
    return a.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").select("n", *rounded(["fnr_diff", "fpr_diff"]))
