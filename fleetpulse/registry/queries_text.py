"""Descriptions, prompts, triage and what-if variants of every test window."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse import scratch_dir
from fleetpulse.fixed_values import ATTR_PHRASES, ATTRIBUTE_WORDS
from fleetpulse.functions.scalars import phrase_of
from fleetpulse.operators import features as FX, patterns as PT, perturb as B, reports as P, scaling as SC, summaries as S, triage as TR, vocabulary as V, windows as W
from fleetpulse.registry import fixtures as X
from fleetpulse.registry.catalog import query
from fleetpulse.registry.fixtures import FEATURES, r6
from fleetpulse.registry.queries_data import WKEY, windows, wkey
from fleetpulse.registry.queries_features import C10_SQL, HSRC
from fleetpulse.registry.queries_patterns import CROSS_PHRASE, CROSS_VOCAB, SHAPE, TUNED, VOCAB, Learned, phrase_case
from fleetpulse.session import materialize

WIN = X.WINDOWS
INDEX = "disk_id * 100000 + datediff('day', date '1970-01-01', end_day)"


def index_of(df):
    return df.withColumn("test_index", F.col("disk_id") * 100000 + F.unix_date("end_day"))


def three(e: str) -> str:
    return f"printf('%.3g', ({e})::double)"


def listed(e: str) -> str:
    return f"'[' || list_aggregate(list_transform({e}, lambda x: cast(round(x, 3) as varchar)), 'string_agg', ', ') || ']'"


def raw_line(c: str) -> str:
    return (f"'- {c}: values=' || {listed(c)} || '; stats(min=' || {three(f'list_min({c})')} || ', max=' || {three(f'list_max({c})')} || ', mean=' || "
            f"{three(f'list_sum({c}) / 30')} || ', first=' || {three(f'{c}[1]')} || ', last=' || {three(f'{c}[30]')} || ', delta=' || {three(f'{c}[30] - {c}[1]')} || ')'")


NL = "chr(10)"


@query("t2_raw_summary", f"with {WIN} select {WKEY}, 'Window index: ' || ({INDEX}) || {NL} || 'Days covered: 0..30 (T=30 days)' || {NL} || {NL} || 'Raw SMART attribute trajectories over the last 30 days:' || {NL} || {f' || {NL} || '.join(raw_line(c) for c in FEATURES)} as summary from win where split = 'test'")
def t2(spark, sf):
    test = index_of(windows(spark, sf).filter("split = 'test'"))
    return wkey(S.describe_raw(test, FEATURES, 30), "summary")


def phrase_line(c: str) -> str:
    return f"'- {c}: ' || max(phrase) filter (where attr = '{c}')"


T3_SQL = f"with {WIN}, {HSRC}, {C10_SQL}, t3 as (select model, disk_id, end_day, max(y) as y, 'Window index: ' || ({INDEX}) || {NL} || 'Days covered: 0..30 (T=30 days)' || {NL} || {NL} || 'Heuristic trend summaries for each SMART attribute:' || {NL} || {f' || {NL} || '.join(phrase_line(c) for c in FEATURES)} as summary from heur where split = 'test' group by model, disk_id, end_day)"


def heuristic_windows(spark, sf):
    months = materialize(W.month_index(X.telemetry(spark, sf)), "months")
    phrased = FX.frame_phrases(W.rows_of_split(X.imputed(spark, sf), months, X.RULE, "test"), FEATURES)
    lab = W.label_windows(phrased, W.earliest_failures(X.failure_tags(spark, sf)))
    wins = W.split_windows(lab, months, X.RULE, (1,)).filter("split = 'test'")
    return S.describe_phrases(index_of(wins), FEATURES, 30)


@query("t3_heuristic_summary", f"{T3_SQL} select {WKEY}, summary from t3")
def t3(spark, sf):
    return wkey(heuristic_windows(spark, sf), "summary")


SYSTEM = "Classify the device from __WINDOW_DAYS__ days, day 0 to day __LAST_DAY__."
USER = "Trends over __WINDOW_DAYS__ days:\n"


@query("t4_prompt_messages", f"{T3_SQL} select {WKEY}, 'plain' as family, 'system' as role, 'Classify the device from 30 days, day 0 to day 29.' as content from t3 union all select {WKEY}, 'plain', 'user', 'Trends over 30 days:' || {NL} || summary from t3 union all select {WKEY}, 'folded', 'user', 'Classify the device from 30 days, day 0 to day 29.' || {NL} || {NL} || 'Trends over 30 days:' || {NL} || summary from t3")
def t4(spark, sf):
    rows = heuristic_windows(spark, sf).select("model", "disk_id", "end_day", "summary")
    out = None
    for family, name in (("plain", "some-model"), ("folded", "org/Gemma-x")):
        part = S.messages(rows, SYSTEM, USER, 30, name).withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part)
    long = out.select("model", "disk_id", "end_day", "family", F.explode("messages").alias("m"))
    return wkey(long, "family", "m.role", "m.content")


# ---- T1: the pattern description --------------------------------------------------------------

def _seg_stats(e: str, n: int) -> str:
    return (f"'; raw_stats(min=' || {three(f'list_min({e})')} || ', max=' || {three(f'list_max({e})')} || ', mean=' || {three(f'list_sum({e}) / {n}')} || ', last=' || "
            f"{three(f'({e})[{n}]')} || ', delta=' || {three(f'({e})[{n}] - ({e})[1]')} || '); raw_values=' || {listed(e)}")


T1_SQL = VOCAB + CROSS_VOCAB + f""",
cvph as (select model, k, {CROSS_PHRASE} as phrase from cvocab),
vph as (select model, k, {phrase_case(ATTR_PHRASES, 'unclassified pattern')} as phrase from vocab),
seg as (select a.model, a.disk_id, a.end_day, a.y, a.p, a.attr, a.raw, v.phrase, a.dist > t.threshold as novel
  from am a join at_t t using (model) join vph v on v.model = a.model and v.k = a.proto where a.split = 'test'),
per as (select model, disk_id, end_day, attr, max(y) as y, count(distinct (phrase, novel)) as kinds, max(phrase) as one, bool_or(novel) as any_novel,
  string_agg('days ' || (p * 5) || '-' || (p * 5 + 5) || ': ' || phrase || case when novel then ' [NOVEL' || {_seg_stats('raw', 5)} || ']' else '' end, '; ' order by p) as parts,
  flatten(list(raw order by p)) as days from seg group by 1, 2, 3, 4),
lines as (select *, '- ' || attr || ': ' || case when kinds = 1 then one || ' across all 30 days of the window' || case when any_novel then ' [NOVEL' || {_seg_stats('days', 30)} || ']' else '' end else parts end as line from per),
cseg as (select c.model, c.disk_id, c.end_day, c.p, coalesce(v.phrase, 'unclassified cross-attribute pattern') as phrase, c.dist > t.threshold as novel from cm c join ct_t t using (model) left join cvph v on v.model = c.model and v.k = c.proto where split = 'test'),
cper as (select model, disk_id, end_day, case when count(distinct (phrase, novel)) = 1 then '- ' || max(phrase) || ' across all 30 days of the window' || case when bool_or(novel) then ' [NOVEL]' else '' end
  else string_agg('- segment days ' || (p * 5) || '-' || (p * 5 + 5) || ': ' || phrase || case when novel then ' [NOVEL]' else '' end, {NL} order by p) end as cline from cseg group by 1, 2, 3),
t1 as (select l.model, l.disk_id, l.end_day, max(l.y) as y, 'Window index: ' || ({INDEX.replace('disk_id', 'l.disk_id').replace('end_day', 'l.end_day')}) || {NL} || {NL} || 'Attribute-level patterns (per SMART attribute):' || {NL}
  || string_agg(line, {NL} order by case attr when 'r_5' then 0 when 'r_187' then 1 when 'r_197' then 2 else 3 end) || {NL} || {NL} || 'Cross-attribute patterns over the whole feature set:' || {NL} || max(cline) as summary
  from lines l join cper using (model, disk_id, end_day) group by 1, 2, 3)"""


def described(spark, sf):
    learned = Learned(spark, sf)
    wins = index_of(learned.windows().filter("split = 'test'"))
    attr = V.phrase_maps(learned.attr_vocab())
    cross = V.phrase_maps(learned.cross_vocab())
    return S.describe_patterns(wins, attr, cross, FEATURES, shape=SHAPE)


@query("t1_pattern_summary", f"with {T1_SQL} select {WKEY}, summary from t1")
def t1(spark, sf):
    return wkey(described(spark, sf), "summary")


@query("t5_summary_dump", f"""{T3_SQL}, d as (select *, row_number() over (order by md5('1|' || disk_id || '|' || strftime(end_day, '%Y-%m-%d')), disk_id, end_day) as rank, count(*) over () as total from t3)
select repeat('=', 80) || {NL} || 'Window ' || rank || '/' || total || ' (global index ' || ({INDEX}) || ', y_status=' || y || ')' || {NL} || {NL} || summary || {NL} || {NL} as value from d""")
def t5(spark, sf):
    from fleetpulse.operators.ranking import hash_rank

    rows = materialize(heuristic_windows(spark, sf).withColumn("g", F.lit(0)), "described")
    ranked = hash_rank(rows, ["g"], ["disk_id", "end_day"], 1)
    total = rows.groupBy("g").agg(F.count("*").alias("total"))
    blocks = S.summary_dump(ranked.join(F.broadcast(total), "g"), "rank", F.col("total"))
    path = scratch_dir(spark, "dump")
    blocks.select("value").write.option("lineSep", "\u0001").text(path)
    return spark.read.option("lineSep", "\u0001").text(path)


JUDGE = "Status {status}, bucket {bucket}.\nWhy: {explanation}\nDo: {recommendations}\nSeen: {summary}"


@query("t6_judge_inputs", f"with {X.ANSWERS} select index, 'Status AT_RISK, bucket ' || pred_ttf_bucket || '.' || {NL} || 'Why: ' || text || {NL} || 'Do: watch the device || turn ' || turn || {NL} || 'Seen: ' || index as prompt from pred where true_status = 1 and pred_status = 1")
def t6(spark, sf):
    pred = X.predictions(spark, sf).withColumn("summary", F.col("index").cast("string"))
    return S.judge_inputs(pred, JUDGE).select("index", "prompt")


# ---- C11 and perturbations --------------------------------------------------------------------

RISK_ATTRS = ["r_5", "r_187", "r_197"]


def _worse(c: str) -> str:
    return f"(n_{c} and {c}[30] <> 0 and {c}[30] - {c}[1] > 0)"


TRIAGE_RULES = f"""
judged as (select *, {' or '.join(_worse(c) for c in RISK_ATTRS)} as risky, {' or '.join(f'({_worse(c)} and {c}[30] - {c}[23] >= 0.5 * ({c}[30] - {c}[1]))' for c in RISK_ATTRS)} as sharp,
  {' or '.join(f'({_worse(c)} and {c}[30] - {c}[23] > 0)' for c in RISK_ATTRS)} as rising, case {' '.join(f"when {_worse(c)} then '{c}'" for c in RISK_ATTRS)} end as driver from flagged),
verdict as (select *, case when risky then 'AT_RISK' else 'HEALTHY' end as status, case when not risky then 'LOW concern' when sharp then 'SERIOUS concern' else 'MEDIUM concern' end as concern_level,
  case when not risky then 'NONE' when sharp then '<7' when rising then '7-30' else '>30' end as ttf_bucket from judged)"""
FLAGGED = TUNED + f""",
nov as (select model, disk_id, end_day, {', '.join(f"bool_or(dist > threshold) filter (where attr = '{c}') as n_{c}" for c in FEATURES)} from am join at_t using (model) where split = 'test' group by 1, 2, 3),
flagged as (select * from win join nov using (model, disk_id, end_day) where split = 'test')"""


@query("c11_risk_triage", f"with {FLAGGED},{TRIAGE_RULES} select {WKEY}, status, concern_level, ttf_bucket, driver from verdict")
def c11(spark, sf):
    wins = Learned(spark, sf).windows().filter("split = 'test'")
    return wkey(TR.triage(wins, FEATURES), "status", "concern_level", "ttf_bucket", "driver")


UP = "list_transform(range(1, 31), lambda i: greatest(case when i >= 24 then list_max({c}) + greatest(1.0, abs(list_max({c})) * 0.3) * (1.0 + (i - 24) / 6) else {c}[i] end, 0.0))"


@query("b1_raise_risk", f"with {WIN} select {WKEY}, {', '.join(f'{r6(f"list_sum(up_{c})")} as {c}_total, {r6(f"up_{c}[24]")} as {c}_first_step, {r6(f"up_{c}[30]")} as {c}_last_step' for c in RISK_ATTRS)} from (select *, {', '.join(UP.format(c=c) + f' as up_{c}' for c in RISK_ATTRS)} from win)")
def b1(spark, sf):
    from fleetpulse.functions.series import total

    rows = windows(spark, sf).withColumns({f"up_{c}": B.raise_risk(F.col(c)) for c in RISK_ATTRS})
    return wkey(rows, *[made for c in RISK_ATTRS for made in (
        F.round(total(F.col(f"up_{c}")), 6).alias(f"{c}_total"), F.round(F.get(f"up_{c}", F.lit(23)), 6).alias(f"{c}_first_step"),
        F.round(F.get(f"up_{c}", F.lit(29)), 6).alias(f"{c}_last_step"))])


@query("b2_lower_risk", f"with {WIN} select {WKEY}, {', '.join(f'greatest(list_min({c}), 0.0) as {c}_lowest, 30 * greatest(list_min({c}), 0.0) as {c}_total' for c in FEATURES)} from win")
def b2(spark, sf):
    from fleetpulse.functions.series import total

    rows = windows(spark, sf).withColumns({f"down_{c}": B.lower_risk(F.col(c)) for c in FEATURES})
    return wkey(rows, *[made for c in FEATURES for made in (F.get(f"down_{c}", F.lit(0)).alias(f"{c}_lowest"), total(F.col(f"down_{c}")).alias(f"{c}_total"))])


def _variant(attr: str, direction: str) -> str:
    change = {"risk_up": UP.format(c=attr), "risk_down": f"list_transform({attr}, lambda x: greatest(list_min({attr}), 0.0))"}.get(direction)
    cols = ", ".join(f"{change} as {c}" if c == attr else c for c in FEATURES)
    return f"select model, disk_id, end_day, '{attr}' as attr, '{direction}' as direction, {cols} from win where split = 'test'"


VARIANTS = "vars as (" + " union all ".join([_variant("NONE", "original"), *[_variant(a, d) for a in ATTRIBUTE_WORDS for d in ("risk_up", "risk_down")]]) + ")"


@query("b3_variants", f"with {WIN}, {VARIANTS} select {WKEY}, attr, direction, {', '.join(f'{r6(f"list_sum({c})")} as {c}' for c in FEATURES)} from vars")
def b3(spark, sf):
    from fleetpulse.functions.series import total

    rows = B.variants(windows(spark, sf).filter("split = 'test'"), FEATURES)
    return wkey(rows, "attr", "direction", *[F.round(total(F.col(c)), 6).alias(c) for c in FEATURES])


def _center_distance(k: int) -> str:
    return "sqrt(" + " + ".join(f"(c{k}[{i}] - z[{i}]) * (c{k}[{i}] - z[{i}])" for i in range(1, 6)) + ")"


VARIANT_PATCHES = " union all ".join(
    f"select model, disk_id, end_day, attr, direction, '{c}' as watched, list_transform({c}[p * 5 + 1 : p * 5 + 5], lambda v: (v - m_{c}) / s_{c}) as z "
    "from vars join srow using (model), (select unnest(range(0, 6)) as p)" for c in RISK_ATTRS)
VERDICTS = TUNED + f""", {VARIANTS},
vz as ({VARIANT_PATCHES}),
vd as (select vz.* exclude (z), least({', '.join(_center_distance(k) for k in range(4))}) as dist from vz join acent using (model)),
vn as (select model, disk_id, end_day, attr, direction, {', '.join(f"bool_or(dist > threshold) filter (where watched = '{c}') as n_{c}" for c in RISK_ATTRS)}
  from vd join at_t using (model) group by 1, 2, 3, 4, 5),
flagged as (select * from vars join vn using (model, disk_id, end_day, attr, direction)),
{TRIAGE_RULES},
ranked as (select *, case when concern_level like 'SERIOUS%' then 2 when concern_level like 'LOW%' then 0 else 1 end as lvl from verdict),
scored as (select r.*, case when direction = 'risk_up' then case when coalesce(driver, '') = attr then 1 else 0 end end as attr_mentioned,
  case when direction = 'risk_up' then case when r.lvl >= o.base then 1 else 0 end when direction = 'risk_down' then case when r.lvl <= o.base then 1 else 0 end end as act_dir_correct
  from ranked r join (select model, disk_id, end_day, lvl as base from ranked where direction = 'original') o using (model, disk_id, end_day))"""


def scored_variants(spark, sf):
    learned = Learned(spark, sf)
    wins = learned.windows().filter("split = 'test'")
    scaler = SC.scaler_row(learned.scaler, FEATURES, ["model"])
    changed = B.reassign(B.variants(wins, FEATURES), FEATURES, scaler, learned.attr, learned.attr_threshold, SHAPE)
    # written once: scoring reads the verdicts twice, as variants and as originals
    verdicts = B.explain(changed, FEATURES).select("model", "disk_id", "end_day", "attr", "direction", "concern_level", "explanation")
    return B.score_variants(materialize(verdicts, "verdicts"), ["model", "disk_id", "end_day"])


@query("b4_j9_direction", f"with {VERDICTS} select {WKEY}, attr, direction, concern_level, attr_mentioned, act_dir_correct from scored")
def b4(spark, sf):
    return wkey(scored_variants(spark, sf), "attr", "direction", "concern_level", "attr_mentioned", "act_dir_correct")


@query("a18_b5_robustness", f"with {VERDICTS} select model, sum(attr_mentioned)::bigint as attr_sens_hits, count(*) filter (where direction = 'risk_up') as attr_sens_total, sum(act_dir_correct)::bigint as act_dir_hits, count(*) filter (where direction <> 'original') as act_dir_total, {r6('avg(attr_mentioned)')} as attr_sens, {r6('avg(act_dir_correct)')} as act_dir_acc from scored group by 1")
def a18(spark, sf):
    r = P.robustness(scored_variants(spark, sf), ["model"])
    return r.select("model", "attr_sens_hits", "attr_sens_total", "act_dir_hits", "act_dir_total", *[F.round(c, 6).alias(c) for c in ("attr_sens", "act_dir_acc")])


@query("a17_judge_means", f"with {X.ANSWERS} select backbone, {r6('avg(1 + n % 5)')} as exp_score, {r6('avg(1 + n % 4)')} as rec_score from pred group by 1")
def a17(spark, sf):
    n = F.length("explanation")
    scores = X.predictions(spark, sf).select("backbone", (1 + n % 5).alias("exp_score"), (1 + n % 4).alias("rec_score"))
    return P.judge_means(scores, ["backbone"]).select("backbone", *[F.round(c, 6).alias(c) for c in ("exp_score", "rec_score")])
