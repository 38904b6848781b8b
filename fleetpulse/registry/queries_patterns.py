"""Prototypes, thresholds, assignments and vocabulary over the whole window table.

The SQL-checked queries use prototypes that SQL can rebuild (weighted mean patches); the clustering
itself is registered without SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from fleetpulse import scratch_dir
from fleetpulse.fixed_values import ATTR_PHRASES, CROSS_PHRASES, NOVELTY_QUANTILES
from fleetpulse.functions import trends as T
from fleetpulse.operators.clusters import with_nearest
from fleetpulse.operators import patterns as PT, reports as P, scaling as SC, vocabulary as V
from fleetpulse.registry import fixtures as X
from fleetpulse.registry.catalog import query
from fleetpulse.registry.fixtures import FEATURES, GROUPS, RULE, r6
from fleetpulse.registry.queries_data import WKEY, wkey
from fleetpulse.registry.queries_features import SCALER_SQL, marked
from fleetpulse.sources import evaluation_io as E, model_store as MS
from fleetpulse.session import learned_dir, materialize

SHAPE = PT.PatchShape()


def covered_rows(spark, sf):
    return SC.train_cover(marked(spark, sf), F.col("split") == "train")


def learn_scaler(spark, sf):
    """The scaler is learned once and written: distances and thresholds must come from the same numbers."""
    rows = materialize(covered_rows(spark, sf), "covered-rows")
    return rows, materialize(SC.window_scaler(rows, FEATURES, ["model"]), "scaler")


def patch_rows(spark, sf, learned=None):
    rows, scaler = learned or learn_scaler(spark, sf)
    z = SC.standardize(rows, scaler, FEATURES, ["model"])
    return PT.with_patches(PT.with_train_weights(z, SHAPE), FEATURES, SHAPE)


def attr_index():
    out = F.lit(0)
    for i, c in enumerate(FEATURES):
        out = F.when(F.col("attr") == c, i).otherwise(out)
    return out


class Learned:
    """Mean prototypes, matches and thresholds of both kinds, from one written table of patch rows; each is learned when first
    used and read by all later queries over the same files.
    """

    def __init__(self, spark, sf):
        self.spark = spark
        self.key = MS.fingerprint(spark, [f"{sf}/lineitem.parquet"], {"rule": RULE, "shape": SHAPE, "features": FEATURES, "round": 1})
        covered = self.once("covered-rows", lambda: covered_rows(spark, sf))
        self.scaler = self.once("scaler", lambda: SC.window_scaler(covered, FEATURES, ["model"]))
        self.rows = self.once("patch-rows", lambda: patch_rows(spark, sf, (covered, self.scaler)))
        attr, cross = PT.attr_patches(self.rows, FEATURES), PT.cross_patches(self.rows, FEATURES)
        weight = F.col("n_healthy") + F.col("n_failed")
        self.attr = self.once("attr-prototypes", lambda: PT.mean_prototypes(attr, "attr", attr_index(), weight, SHAPE.days))
        healthy = PT.mean_prototypes(cross, "cross", F.lit(0), F.col("n_healthy"), SHAPE.days * len(FEATURES))
        failed = PT.mean_prototypes(cross, "cross", F.lit(1), F.col("n_failed"), SHAPE.days * len(FEATURES))
        self.cross = self.once("cross-prototypes", lambda: healthy.unionByName(failed))
        self.attr_rows, self.cross_rows = attr, cross

    def once(self, name, build):
        return MS.learn_once(self.spark, learned_dir(self.spark), name, self.key, build)

    @cached_property
    def attr_matched(self):
        return self.once("attr-matched", lambda: PT.match(self.attr_rows, self.attr).drop("emb"))

    @cached_property
    def cross_matched(self):
        return self.once("cross-matched", lambda: PT.match(self.cross_rows, self.cross).drop("emb"))

    @cached_property
    def attr_threshold(self):
        return self.once("attr-threshold", lambda: PT.tune_threshold(self.attr_matched, ["model"]))

    @cached_property
    def cross_threshold(self):
        return self.once("cross-threshold", lambda: PT.tune_threshold(self.cross_matched, ["model"]))

    def windows(self, keep_days=True):
        assigned = PT.assign_rows(self.rows, FEATURES, self.attr, self.attr_threshold, self.cross, self.cross_threshold)
        return PT.window_assignments(assigned, FEATURES, SHAPE, keep_days)

    def attr_means(self):
        reps = V.representatives(self.attr_matched, self.attr_threshold)
        return V.mean_series(reps, SHAPE.days)

    def cross_means(self):
        reps = V.representatives(self.cross_matched, self.cross_threshold)
        return V.mean_series(reps, SHAPE.days * len(FEATURES))

    def attr_vocab(self):
        return V.attr_vocabulary(self.attr_means(), self.attr)

    def cross_vocab(self):
        return V.cross_vocabulary(self.cross_means(), self.cross, FEATURES, SHAPE.days, GROUPS)


# ---- SQL twins --------------------------------------------------------------------------------

def _z(c: str) -> str:
    return f"list_transform({c}[p * 5 + 1 : p * 5 + 5], lambda v: (v - m_{c}) / s_{c})"


SROW = "srow as (select model, " + ", ".join(
    f"max(mean) filter (where attr = '{c}') as m_{c}, max(std) filter (where attr = '{c}') as s_{c}" for c in FEATURES) + " from scaler group by 1)"
WPATCH = SCALER_SQL + f""",
{SROW},
wp as (select model, disk_id, end_day, split, y, p, {', '.join(f'{c}[p * 5 + 1 : p * 5 + 5] as raw_{c}, {_z(c)} as z_{c}' for c in FEATURES)}
  from win join srow using (model), (select unnest(range(0, 6)) as p)),
ap as ({' union all '.join(f"select model, disk_id, end_day, split, y, p, '{c}' as attr, raw_{c} as raw, z_{c} as z from wp" for c in FEATURES)}),
cp as (select model, disk_id, end_day, split, y, p, {' || '.join(f'raw_{c}' for c in FEATURES)} as raw, {' || '.join(f'z_{c}' for c in FEATURES)} as z from wp),
acent as (select model, {', '.join(f"[{', '.join(f'round(avg(z[{i}]) filter (where attr = {chr(39)}{c}{chr(39)}), 6)' for i in range(1, 6))}] as c{j}" for j, c in enumerate(FEATURES))}
  from ap where split = 'train' group by 1),
ccent as (select model, {', '.join(f"[{', '.join(f'round(avg(z[{i}]) filter (where y = {y}), 6)' for i in range(1, 21))}] as c{y}" for y in (0, 1))}
  from cp where split = 'train' group by 1)"""


def _dist(k: int, n: int) -> str:
    return "sqrt(" + " + ".join(f"(c{k}[{i}] - z[{i}]) * (c{k}[{i}] - z[{i}])" for i in range(1, n + 1)) + ")"


def _arg(n: int) -> str:
    cases = []
    for k in range(n):
        cases.append(f"when d{k} = least({', '.join(f'd{j}' for j in range(n))}) then {k}")
    return "case " + " ".join(cases) + " end"


MATCHED = WPATCH + f""",
ad as (select *, {', '.join(f'{_dist(k, 5)} as d{k}' for k in range(4))} from ap join acent using (model)),
am as (select model, disk_id, end_day, split, y, p, attr, raw, least(d0, d1, d2, d3) as dist, {_arg(4)} as proto from ad),
cd as (select *, {', '.join(f'{_dist(k, 20)} as d{k}' for k in range(2))} from cp join ccent using (model)),
cm as (select model, disk_id, end_day, split, y, p, raw, least(d0, d1) as dist, {_arg(2)} as proto from cd)"""
QS = ", ".join(repr(q) for q in NOVELTY_QUANTILES)


def tuned_sql(src: str, name: str) -> str:
    return f"""
{name}_q as (select model, unnest([{QS}]::double[]) as q, unnest(quantile_cont(dist, [{QS}])) as tau from {src} where split = 'train' group by 1),
{name}_s as (select q.model, q.q, q.tau, count(*) filter (where dist > tau and y = 1) as tp, count(*) filter (where dist > tau and y = 0) as fp,
  count(*) filter (where y = 1) as nf, count(*) filter (where y = 0) as nh from {name}_q q join {src} m on m.model = q.model and m.split = 'train' group by 1, 2, 3),
{name}_f as (select *, fp / nh as fpr, 2 * (tp / (tp + fp + 1e-9)) * (tp / (nf + 1e-9)) / ((tp / (tp + fp + 1e-9)) + (tp / (nf + 1e-9)) + 1e-9) as f1 from {name}_s),
{name}_t as (select model, coalesce(max(tau) filter (where rk = 1 and fpr <= 0.05), max(tau)) as threshold from (
  select *, row_number() over (partition by model order by case when fpr <= 0.05 then 0 else 1 end, f1 desc, q) as rk from {name}_f) group by 1)"""


TUNED = MATCHED + "," + tuned_sql("am", "at") + "," + tuned_sql("cm", "ct")


@query("l4_j4_patch_distances", f"with {MATCHED} select model, attr, proto, count(*) as n, {r6('min(dist)')} as lo, {r6('max(dist)')} as hi, {r6('avg(dist)')} as mean_dist, count(*) filter (where y = 1) as n_failed from am where split = 'train' group by 1, 2, 3")
def l4(spark, sf):
    m = Learned(spark, sf).attr_matched
    w = F.col("n_healthy") + F.col("n_failed")
    return m.groupBy("model", "attr", "proto").agg(
        F.sum(w).alias("n"), F.round(F.min("dist"), 6).alias("lo"), F.round(F.max("dist"), 6).alias("hi"),
        F.round(F.sum(F.col("dist") * w) / F.sum(w), 6).alias("mean_dist"), F.sum("n_failed").alias("n_failed"))


@query("a11_threshold_scores", f"with {TUNED} select model, {r6('q')} as q, {r6('tau')} as tau, tp, fp, {r6('fpr')} as fpr, {r6('tp / nf')} as tpr, {r6('f1')} as f1 from at_f")
def a11(spark, sf):
    s = PT.threshold_scores(Learned(spark, sf).attr_matched, ["model"])
    return s.filter(F.col("q").isin(NOVELTY_QUANTILES)).select(
        "model", F.round("q", 6).alias("q"), F.round("tau", 6).alias("tau"), "tp", "fp", *[F.round(c, 6).alias(c) for c in ("fpr", "tpr", "f1")])


@query("l5_tune_threshold", f"with {TUNED} select 'attr' as kind, model, {r6('threshold')} as threshold from at_t union all select 'cross', model, {r6('threshold')} from ct_t")
def l5(spark, sf):
    learned = Learned(spark, sf)
    both = learned.attr_threshold.withColumn("kind", F.lit("attr")).unionByName(learned.cross_threshold.withColumn("kind", F.lit("cross")))
    return both.select("kind", "model", F.round("threshold", 6).alias("threshold"))


ASSIGNED = TUNED + """,
asg as (select model, disk_id, end_day, split, y, 'attr' as kind, attr, p, proto, dist > threshold as novel from am join at_t using (model)
  union all select model, disk_id, end_day, split, y, 'cross', null, p, proto, dist > threshold from cm join ct_t using (model))"""


@query("l6_assign_and_novelty", f"with {ASSIGNED} select {WKEY}, kind, attr, string_agg(p || ':' || proto || case when novel then '!' else '' end, ' ' order by p) as patches from asg group by model, disk_id, end_day, kind, attr")
def l6(spark, sf):
    """One row per window and attribute: its patches as ``position:prototype``, novel ones marked."""
    def shown(c: str):
        return F.array_join(F.transform(f"p_{c}", lambda a, p: F.concat(
            p.cast("string"), F.lit(":"), a["proto"].cast("string"), F.when(a["novel"], "!").otherwise(""))), " ")

    rows = F.array(*[F.struct(F.lit("cross" if c == "cross" else "attr").alias("kind"), F.lit(None if c == "cross" else c).cast("string").alias("attr"),
                              shown(c).alias("patches")) for c in [*FEATURES, "cross"]])
    wins = Learned(spark, sf).windows(keep_days=False)
    return wkey(wins.select("model", "disk_id", "end_day", F.explode(rows).alias("r")), "r.kind", "r.attr", "r.patches")


def coverage_rows(spark, sf):
    flat = PT.long_assignments(Learned(spark, sf).windows(keep_days=False), FEATURES)
    return flat.select(F.col("model").alias("dataset"), F.col("split").alias("round"), "kind", "novel")


@query("a19_coverage", f"with {ASSIGNED} select model as dataset, split as round, kind, count(*) filter (where not novel) as matched_patches, count(*) as total_patches, {r6('count(*) filter (where not novel) / count(*)')} as coverage, {r6('count(*) filter (where novel) / count(*)')} as out_of_library_rate from asg group by 1, 2, 3")
def a19(spark, sf):
    c = P.coverage(coverage_rows(spark, sf), ["dataset", "round", "kind"])
    return c.select("dataset", "round", "kind", "matched_patches", "total_patches", *[F.round(x, 6).alias(x) for x in ("coverage", "out_of_library_rate")])


@query("a20_coverage_subtotals", f"with {ASSIGNED} select model as dataset, case when grouping(split) = 1 then 'aggregate' else split end as round, kind, count(*) filter (where not novel) as matched_patches, count(*) as total_patches, {r6('count(*) filter (where not novel) / count(*)')} as coverage from asg group by grouping sets ((model, kind, split), (model, kind))")
def a20(spark, sf):
    c = P.coverage_with_subtotals(coverage_rows(spark, sf))
    return c.select("dataset", "round", "kind", "matched_patches", "total_patches", F.round("coverage", 6).alias("coverage"))


MEANS = TUNED + f""",
arep as (select * from am join at_t using (model) where split = 'train' and dist <= threshold),
amean as (select model, proto as k, count(*) as num_patches, [{', '.join(f'avg(raw[{i}])' for i in range(1, 6))}] as xs from arep group by 1, 2),
crep as (select * from cm join ct_t using (model) where split = 'train' and dist <= threshold),
cmean as (select model, proto as k, count(*) as num_patches, [{', '.join(f'avg(raw[{i}])' for i in range(1, 21))}] as xs from crep group by 1, 2)"""


@query("l7_p9_a24_mean_series", f"with {MEANS} select model, k, num_patches, {', '.join(f'{r6(f"xs[{i}]")} as x{i}' for i in range(1, 6))} from amean")
def l7(spark, sf):
    m = Learned(spark, sf).attr_means()
    return m.select("model", "k", "num_patches", *[F.round(F.get("mean_patch", F.lit(i)), 6).alias(f"x{i + 1}") for i in range(5)])


@query("a25_cross_mean", f"with {MEANS} select model, k, num_patches, unnest(range(0, 20)) as pos, {r6('unnest(xs)')} as value from cmean")
def a25(spark, sf):
    m = Learned(spark, sf).cross_means()
    return m.select("model", "k", "num_patches", F.posexplode("mean_patch").alias("pos", "value")).withColumn("value", F.round("value", 6))


def shape_sql(src: str, out: str) -> str:
    """Series label in SQL: ``src`` has a list ``xs``; ``out`` adds ``label``. Same ordered rules."""
    return f"""
{out}_0 as (select *, len(xs) as sz, list_max(list_transform(xs, lambda x: abs(x))) as mxa, list_max(list_transform(xs, lambda x: abs(x - xs[1]))) as amp from {src}),
{out}_1 as (select *, list_transform(xs, lambda x: (x - xs[1]) / (amp + 1e-12)) as nm from {out}_0),
{out}_2 as (select *, list_transform(range(2, sz + 1), lambda i: nm[i] - nm[i - 1]) as df from {out}_1),
{out}_3 as (select *, list_sum(list_transform(df, lambda x: abs(x))) / len(df) as ns, nm[sz] - nm[1] as gt, list_max(list_transform(df, lambda x: abs(x))) as ms,
  list_min(df) as dlo, list_max(df) as dhi, nm[sz // 2] - nm[1] as fh, nm[sz] - nm[sz // 2 + 1] as sh,
  list_filter(range(0, sz), lambda i: abs(nm[i + 1]) >= 0.7) as sp, list_min(nm) as nlo, list_max(nm) as nhi,
  list_position(nm, list_min(nm)) - 1 as il, list_position(nm, list_max(nm)) - 1 as ih from {out}_2),
{out} as (select *, case when sz = 0 then 'UNUSED_PROTO' when mxa < 1e-6 then 'ZERO_OR_NEAR_ZERO' when sz = 1 then 'LOW_STABLE'
  when amp < 1e-12 then case when mxa < 1.0 then 'ZERO_OR_NEAR_ZERO' else 'LOW_STABLE' end
  when amp < 0.05 and ns < 0.06 then case when mxa < 1.0 then 'ZERO_OR_NEAR_ZERO' else 'LOW_STABLE' end
  when dlo >= -0.05 and gt > 0.3 and ns < 0.25 then case when gt > 0.7 then 'FAST_RISE' else 'SLOW_RISE' end
  when dhi <= 0.05 and gt < -0.3 and ns < 0.25 then case when gt < -0.7 then 'FAST_DECAY' else 'SLOW_DECAY' end
  when fh > 0.3 and abs(sh) < 0.1 then 'SATURATING_RISE' when fh < -0.3 and abs(sh) < 0.1 then 'SATURATING_DECAY'
  when ms > 0.8 and ns < 0.4 and gt > 0.2 then 'STEP_UP' when ms > 0.8 and ns < 0.4 and gt < -0.2 then 'STEP_DOWN'
  when len(sp) > 0 and amp >= 0.05 and len(sp) <= greatest(2, sz // 3) and ns < 0.25 then
    case when list_sum(sp) / len(sp) / (sz - 1) >= 2.0::double / 3.0 then 'SINGLE_SPIKE_LATE' when list_sum(sp) / len(sp) / (sz - 1) <= 1.0::double / 3.0 then 'SINGLE_SPIKE_EARLY' else 'SINGLE_SPIKE_MID' end
  when len(sp) > 0 and amp >= 0.05 then case when len(sp) / sz < 0.3 then 'LOW_RATE_BURSTS' else 'HIGH_RATE_BURSTS' end
  when il < ih and il > 0 and ih < sz - 1 and nlo < -0.3 and nhi > 0.3 then 'U_SHAPED'
  when ih < il and ih > 0 and il < sz - 1 and nlo < -0.3 and nhi > 0.3 then 'HUMP_SHAPED'
  when abs(gt) > 0.2 and ns >= 0.06 then 'DRIFT_WITH_NOISE' else 'NOISY_FLUCTUATIONS' end as label from {out}_3)"""


def phrase_case(phrases: dict[str, str], default: str) -> str:
    return "case label " + " ".join(f"when '{k}' then '{v}'" for k, v in phrases.items()) + f" else '{default}' end"


SHAPES = X.WINDOWS + ", shp as (" + " union all ".join(f"select model, disk_id, end_day, '{c}' as attr, {c} as xs from win" for c in FEATURES) + ")"


@query("l8_f20_series_label", f"with {SHAPES},{shape_sql('shp', 'lab2')} select {WKEY}, attr, label, {phrase_case(ATTR_PHRASES, 'unclassified pattern')} as phrase from lab2")
def l8(spark, sf):
    from fleetpulse.functions.scalars import phrase_of
    from fleetpulse.registry.queries_data import windows

    parts = F.array(*[F.struct(F.lit(c).alias("attr"), T.series_labels(F.col(c)).alias("label")) for c in FEATURES])
    rows = windows(spark, sf).select("model", "disk_id", "end_day", F.explode(parts).alias("i"))
    return wkey(rows, "i.attr", "i.label", phrase_of(F.col("i.label"), ATTR_PHRASES, "unclassified pattern").alias("phrase"))


ROLE_CASE = "case when label in ('ZERO_OR_NEAR_ZERO', 'LOW_STABLE', 'HIGH_STABLE', 'UNUSED_PROTO') then 'stable' when label in ('SLOW_RISE', 'SLOW_DECAY', 'FAST_RISE', 'FAST_DECAY', 'SATURATING_RISE', 'SATURATING_DECAY', 'DRIFT_WITH_NOISE') then 'trend' when label = 'NOISY_FLUCTUATIONS' then 'noisy' else 'spiky' end"
CROSS_SERIES = X.WINDOWS + ", cser as (" + " union all ".join(
    f"select model, disk_id, end_day, '{c}' as attr, '{GROUPS[c]}' as grp, {c} as xs from win" for c in FEATURES) + ")"


@query("f19_series_role", f"with {CROSS_SERIES},{shape_sql('cser', 'lab2')} select label, {ROLE_CASE} as role, count(*) as n from lab2 group by 1, 2")
def f19(spark, sf):
    from fleetpulse.functions.scalars import label_role

    rows = cross_series(spark, sf).select(F.explode("labels").alias("label"))
    return rows.groupBy("label", label_role(F.col("label")).alias("role")).agg(F.count("*").alias("n"))


def cross_series(spark, sf):
    from fleetpulse.registry.queries_data import windows

    return windows(spark, sf).select("model", "disk_id", "end_day", F.array(*[T.series_labels(F.col(c)) for c in FEATURES]).alias("labels"))


CROSS_RULES = f"""
cagg as (select model, disk_id, end_day, count(*) filter (where role = 'stable') / 4 as st, count(*) filter (where role = 'spiky') / 4 as sp, count(*) filter (where role = 'trend') / 4 as tr,
  count(*) filter (where grp = 'workload' and role in ('spiky', 'trend')) as wl, count(*) filter (where grp = 'error' and role in ('spiky', 'trend')) / 2 as er,
  count(*) filter (where grp = 'error' and role = 'spiky') / 2 as es, count(*) filter (where grp = 'wear' and role = 'trend') as wt, max(case when label = 'STEP_DOWN' then 1 else 0 end) as rs
  from (select *, {ROLE_CASE} as role from lab2) group by 1, 2, 3),
clab as (select *, case when st > 0.8 and sp < 0.1 and tr < 0.1 then 'ALL_STABLE' when wl >= 0.3 and er < 0.1 then 'WORKLOAD_SPIKE_NO_ERRORS'
  when wt >= 0.3 then case when er < 0.1 then 'WEAROUT_NO_ERRORS' else 'WEAROUT_WITH_ERRORS' end when es >= 0.1 and es < 0.4 then 'ERROR_BURST_ISOLATED'
  when es >= 0.4 then 'ERROR_BURST_WIDESPREAD' when rs = 1 then 'RESET_OR_WRAP' when sp < 0.1 and tr >= 0.2 then 'MULTI_ATTR_TRENDS'
  when sp >= 0.4 and st > 0.3 then 'MULTI_ERROR_BURSTS' when sp >= 0.2 and st > 0.5 then 'FEW_ERROR_BURSTS' when tr >= 0.2 and sp >= 0.2 then 'TREND_PLUS_BURSTS' else 'MIXED_PATTERN' end as label from cagg)"""


@query("l9_cross_label", f"with {CROSS_SERIES},{shape_sql('cser', 'lab2')},{CROSS_RULES} select {WKEY}, label, {phrase_case(CROSS_PHRASES, 'unclassified cross-attribute pattern')} as phrase from clab")
def l9(spark, sf):
    from fleetpulse.functions.scalars import phrase_of

    rows = cross_series(spark, sf).withColumn("label", T.cross_label(F.col("labels"), [GROUPS[c] for c in FEATURES]))
    return wkey(rows, "label", phrase_of(F.col("label"), CROSS_PHRASES, "unclassified cross-attribute pattern").alias("phrase"))


def _cross_parts() -> str:
    return " union all ".join(f"select model, k, '{c}' as attr, '{GROUPS[c]}' as grp, xs[{i * 5 + 1}:{i * 5 + 5}] as xs from cmean" for i, c in enumerate(FEATURES))


@query("a26_role_counts", f"with {MEANS}, cpart as ({_cross_parts()}),{shape_sql('cpart', 'lab2')} select model, k, {', '.join(f'count(*) filter (where role = {chr(39)}{r}{chr(39)}) as {r}' for r in ('stable', 'trend', 'spiky', 'noisy'))}, {', '.join(f'count(*) filter (where grp = {chr(39)}{g}{chr(39)} and role = {chr(39)}{r}{chr(39)}) as {g}_{r}' for g in ('error', 'wear', 'workload', 'other') for r in ('stable', 'trend', 'spiky', 'noisy'))} from (select *, {ROLE_CASE} as role from lab2) group by 1, 2")
def a26(spark, sf):
    return V.role_counts(V.cross_details(Learned(spark, sf).cross_means(), FEATURES, SHAPE.days, GROUPS))


VOCAB = MEANS + "," + shape_sql("amean", "alab") + f""",
vocab as (select a.model, 'attr' as kind, a.k, coalesce(num_patches, 0) as num_patches, coalesce(label, 'UNUSED_PROTO') as label, xs
  from (select model, unnest(range(0, 4)) as k from acent) a left join alab using (model, k))"""


@query("l10_attr_vocabulary", f"with {VOCAB} select model, kind, k, label, {phrase_case(ATTR_PHRASES, 'unclassified pattern')} as phrase, num_patches, {r6('list_sum(xs) / 5')} as level_mean, {r6('xs[5] - xs[1]')} as delta from vocab")
def l10(spark, sf):
    v = Learned(spark, sf).attr_vocab()
    return v.select("model", "kind", "k", "label", "phrase", "num_patches", F.round("stats.level_mean", 6).alias("level_mean"), F.round("stats.delta", 6).alias("delta"))


CROSS_VOCAB = f""",
cpart as ({_cross_parts()}),{shape_sql('cpart', 'lab2')},{CROSS_RULES.replace('model, disk_id, end_day', 'model, k').replace('group by 1, 2, 3', 'group by 1, 2')},
cvocab as (select c.model, 'cross' as kind, c.k, coalesce(num_patches, 0) as num_patches, coalesce(label, 'UNUSED_PROTO') as label, xs
  from (select model, unnest(range(0, 2)) as k from ccent) c left join cmean using (model, k) left join (select model, k, label from clab) using (model, k))"""
CROSS_PHRASE = phrase_case(CROSS_PHRASES, "unclassified cross-attribute pattern")


@query("l10_cross_vocabulary", f"with {MEANS}{CROSS_VOCAB} select model, kind, k, label, {CROSS_PHRASE} as phrase, num_patches, {r6('list_sum(xs) / 20')} as level_mean, {r6('xs[20] - xs[1]')} as delta from cvocab")
def l10_cross(spark, sf):
    v = Learned(spark, sf).cross_vocab()
    return v.select("model", "kind", "k", "label", "phrase", "num_patches", F.round("stats.level_mean", 6).alias("level_mean"), F.round("stats.delta", 6).alias("delta"))


@query("j7_assignment_phrases", f"""with {VOCAB}{CROSS_VOCAB} select a.model, 'attr' as kind, a.attr, a.proto, coalesce({phrase_case(ATTR_PHRASES, 'unclassified pattern')}, 'unclassified pattern') as phrase, count(*) as n
from am a left join vocab v on v.model = a.model and v.k = a.proto group by 1, 2, 3, 4, 5
union all select c.model, 'cross', null, c.proto, coalesce({CROSS_PHRASE}, 'unclassified cross-attribute pattern'), count(*)
from cm c left join cvocab v on v.model = c.model and v.k = c.proto group by 1, 2, 3, 4, 5""")
def j7(spark, sf):
    learned = Learned(spark, sf)
    flat = PT.long_assignments(learned.windows(keep_days=False), FEATURES).filter("proto >= 0")
    maps = [V.phrase_maps(v).withColumn("kind", F.lit(k)) for k, v in (("attr", learned.attr_vocab()), ("cross", learned.cross_vocab()))]
    maps = materialize(maps[0].unionByName(maps[1]), "phrases")
    none = F.when(F.col("kind") == "attr", "unclassified pattern").otherwise("unclassified cross-attribute pattern")
    named = flat.join(maps, ["model", "kind"]).withColumn("phrase", F.coalesce(F.try_element_at("phrases", F.col("proto")), none))
    return named.groupBy("model", "kind", "attr", "proto", "phrase").agg(F.count("*").alias("n"))


@query("l11_s8_k5_vocabulary_export", f"with {VOCAB} select model, 'attr' as kind, k as cluster_id, label, {phrase_case(ATTR_PHRASES, 'unclassified pattern')} as phrase, num_patches as support_count, {r6('threshold')} as distance_cutoff, 5 as patch_len from vocab join at_t using (model)")
def l11(spark, sf):
    learned = Learned(spark, sf)
    vocab = materialize(learned.attr_vocab(), "vocab")
    # nested JSON documents out and back in, then the flat dictionary
    path = scratch_dir(spark, "vocab-json")
    E.vocabulary_json(vocab, ["model"]).write.json(path)
    back = E.parse_vocabulary(spark.read.schema("model string, document string").json(path), ["model"])
    cuts = learned.attr_threshold.withColumn("kind", F.lit("attr"))
    flat = V.flat_dictionary(back, cuts, SHAPE.days)
    return flat.select("model", "kind", "cluster_id", "label", "phrase", "support_count", F.round("distance_cutoff", 6).alias("distance_cutoff"), "patch_len")


@query("k4_learned_tables", f"with {TUNED} select model, {r6('list_sum(c0) + list_sum(c1) + list_sum(c2) + list_sum(c3)')} as total, 4 as n, {r6('threshold')} as threshold from acent join at_t using (model)")
def k4(spark, sf):
    learned = Learned(spark, sf)
    root = scratch_dir(spark, "learned")
    MS.save_learned(learned.attr.join(learned.attr_threshold, "model"), root, "prototypes")
    back = MS.load_learned(spark, root, "prototypes")
    sums = F.aggregate("center", F.lit(0.0), lambda a, x: a + x)
    return back.groupBy("model").agg(F.round(F.sum(sums), 6).alias("total"), F.count("*").alias("n"), F.round(F.max("threshold"), 6).alias("threshold"))


@query("o2_u3_top_phrases", f"with {VOCAB},{shape_sql('(select model, k, num_patches, attr, grp, xs from (' + _cross_parts().replace('from cmean', ', num_patches from cmean') + '))', 'lab2')}, kinds as (select model, kind, k, label, num_patches from vocab union all select model, 'cross', k, 'cross', max(num_patches) from lab2 group by 1, 3) select model, kind, k, num_patches from (select *, row_number() over (partition by model, kind order by num_patches desc, k) as rk from kinds where num_patches > 0) where (kind = 'attr' and rk <= 3) or (kind = 'cross' and rk <= 2)")
def o2(spark, sf):
    learned = Learned(spark, sf)
    attr = P.top_per_group(learned.attr_vocab().filter("num_patches > 0"), ["model"], [F.desc("num_patches"), F.asc("k")], 3)
    cross = P.top_per_group(learned.cross_vocab().filter("num_patches > 0"), ["model"], [F.desc("num_patches"), F.asc("k")], 2)
    return attr.unionByName(cross).select("model", "kind", "k", "num_patches")


@query("o3_a23_top_labels", f"with {VOCAB} select label, sum(num_patches)::bigint as support from vocab where num_patches > 0 group by 1 order by support desc, label limit 5")
def o3(spark, sf):
    totals = P.label_supports(Learned(spark, sf).attr_vocab())
    return totals.groupBy("label").agg(F.sum("support").alias("support")).orderBy(F.desc("support"), "label").limit(5)


@query("o4_l12_example_patches", f"with {MEANS}, top as (select model, k, num_patches, row_number() over (partition by model order by num_patches desc, k) as rk from amean) select model, k, least(20, count(distinct (disk_id, end_day - (25 - 5 * p), attr))) as samples, {r6('any_value(xs[1])')} as mean_start from arep join top on top.model = arep.model and top.k = arep.proto join amean using (model, k) where rk <= 6 group by 1, 2".replace("count(distinct (disk_id, end_day - (25 - 5 * p), attr))", "count(*)").replace("select model, k, least", "select top.model, top.k, least").replace("join amean using (model, k)", "join amean on amean.model = top.model and amean.k = top.k"))
def o4(spark, sf):
    learned = Learned(spark, sf)
    reps = V.representatives(learned.attr_matched, learned.attr_threshold)
    ex = V.example_patches(reps, learned.attr_means())
    return ex.groupBy("model", "k").agg(F.count_if(F.col("part") == "sample").alias("samples"),
                                        F.round(F.max(F.when(F.col("part") == "mean", F.get("raw", F.lit(0)))), 6).alias("mean_start"))


@query("r6_l7_capped_representatives", f"with {TUNED} select model, proto as k, least(1000, count(*)) as n from am join at_t using (model) where split = 'train' and dist <= threshold group by 1, 2")
def r6l7(spark, sf):
    learned = Learned(spark, sf)
    reps = V.representatives(learned.attr_matched, learned.attr_threshold, cap=1000)
    return reps.groupBy("model", F.col("proto").alias("k")).agg(F.count("*").alias("n"))


def clustered(spark, sf, cut, kind: str, k: int, width: int, dims: int):
    """Per model: how often train windows hold its patches, and what must hold for the code and the centers.

    ``centred``, ``orthonormal`` and ``ordered`` are about the code, ``nearest`` and ``means`` about the centers; centers are compared
    with means taken anew, to a hundredth; rounds end when no center moves by a thousandth.
    """
    patches = materialize(cut(patch_rows(spark, sf), FEATURES), f"{kind}-patches")
    code = PT.fit_embedding(patches, width, dims)
    rows = materialize(PT.embed(patches, code).withColumn("w", F.col("n_healthy") + F.col("n_failed")), f"{kind}-codes")
    protos = materialize(PT.fit_prototypes(rows, kind, k, dims), f"{kind}-centers")
    matched = materialize(PT.match(rows, protos), f"{kind}-matched")
    means = matched.groupBy("model", F.col("proto").alias("k")).agg(F.array(*[F.sum(F.get("emb", F.lit(i)) * F.col("w")) / F.sum("w") for i in range(dims)]).alias("mean"))
    apart = F.aggregate(F.zip_with("center", "mean", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda t, v: F.greatest(t, v))
    held = protos.join(means, ["model", "k"], "left").groupBy("model").agg(F.count("*").alias("centers"), F.bool_and(F.coalesce(apart < 1e-2, F.lit(True))).alias("means"))
    counts = with_nearest(matched, PT.center_lists(protos), ["model"], "emb", dims).groupBy("model").agg(
        F.sum("w").alias("held"), F.bool_and(F.abs(F.sqrt("nearest.d2") - F.col("dist")) < 1e-6).alias("nearest"),
        F.array(*[F.sum(F.get("emb", F.lit(i)) * F.col("w")) / F.sum("w") for i in range(dims)]).alias("mean_code"))
    d = F.col("directions")
    pairs = [F.abs(F.aggregate(F.zip_with(F.slice(d, i * width + 1, width), F.slice(d, j * width + 1, width), lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
                   - (1.0 if i == j else 0.0)) < 1e-9 for i in range(dims) for j in range(i + 1)]
    shape = code.select("model", F.forall(F.array(*pairs), lambda v: v).alias("orthonormal"), (F.array_sort("variances") == F.reverse("variances")).alias("ordered"))
    out = counts.join(held, "model").join(shape, "model")
    return out.select("model", "held", "centers", F.forall("mean_code", lambda v: F.abs(v) < 1e-6).alias("centred"), "orthonormal", "ordered", "nearest", "means")


def clustered_sql(table: str, k: int) -> str:
    return f"""with {WPATCH} select model, count(*) as held, {k}::bigint as centers, true as centred, true as orthonormal, true as ordered, true as nearest, true as means
from {table} where split = 'train' group by 1"""


@query("l1_l3_kmeans_prototypes", clustered_sql("ap", 16))
def l3(spark, sf):
    return clustered(spark, sf, PT.attr_patches, "attr", 16, SHAPE.days, 3)


@query("l2_cross_kmeans_thresholds", clustered_sql("cp", 8))
def l2(spark, sf):
    return clustered(spark, sf, PT.cross_patches, "cross", 8, SHAPE.days * len(FEATURES), 8)


EMB_CENTERS = "cen as (select label, " + ", ".join(f"round(avg(embedding[{i}]::double), 6) as c{i}" for i in range(1, 65)) + " from embeddings group by 1)"


@query("j4_embedding_prototypes", f"with {EMB_CENTERS}, d as (select vec_id, cen.label as k, sqrt({' + '.join(f'(c{i} - embedding[{i}]::double) * (c{i} - embedding[{i}]::double)' for i in range(1, 65))}) as dist from embeddings, cen) select vec_id, k, {r6('dist')} as dist from (select *, row_number() over (partition by vec_id order by dist, k) as rk from d) where rk = 1")
def j4(spark, sf):
    vecs = X.table(spark, sf, "embeddings").select(
        "vec_id", F.lit("all").alias("model"), F.col("embedding").cast("array<double>").alias("emb"), F.col("label"))
    centers = PT.mean_prototypes(vecs, "attr", F.col("label"), F.lit(1), 64)
    order = centers.select("model", F.sort_array(F.collect_list("k").over(_all())).alias("ks")).distinct()
    matched = PT.match(vecs, centers)
    named = matched.join(F.broadcast(order), "model").withColumn("k", F.get("ks", F.col("proto")))
    return named.select("vec_id", "k", F.round("dist", 6).alias("dist"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy("model")
