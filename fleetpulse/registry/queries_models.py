"""Mutation features, neighbours, classifiers and their evaluation on the test split; parameter sweeps."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from fleetpulse.fixed_values import HISTOGRAM_BINS
from fleetpulse.functions import series as S
from fleetpulse.operators import features as FX, metrics as M, models as MD, mutation as MU, neighbours as NB, reports as P, sampling as R, scaling as SC, windows as W
from fleetpulse.plans import sensitivity as PS
from fleetpulse.registry import fixtures as X
from fleetpulse.registry.catalog import query
from fleetpulse.registry.fixtures import FEATURES, RULE, r6
from fleetpulse.registry.queries_data import WKEY, windows, wkey
from fleetpulse.registry.queries_features import cells, cells_sql, marked, ranges
from fleetpulse.registry.queries_patterns import SROW, tuned_sql
from fleetpulse.registry.queries_sampling import KEYS, h
from fleetpulse.session import materialize

WIN = X.WINDOWS
# the forecast: products of all columns of the healthy train windows, and elimination row by row (the ridge keeps pivots positive)
XS = [f"{c}[{k}]" for c in FEATURES for k in range(1, 21)]
YS = [f"{c}[{k}]" for c in FEATURES for k in range(21, 31)]
NX, NY = len(XS), len(YS)
MUT = "with recursive " + WIN + f""",
vecs as (select model, disk_id, end_day, split, y, [{', '.join(XS)}] as x, [{', '.join(YS)}] as f from win),
cols as materialized (select model, i, list(v order by disk_id, end_day) as v, sum(v) as s, count(*) as n from (
  select model, disk_id, end_day, unnest(x || f) as v, unnest(range({NX + NY})) as i from vecs where split = 'train' and y = 0) group by 1, 2),
cov as materialized (select a.model, a.i, b.i as j, a.s / a.n as mi, list_dot_product(a.v, b.v) / a.n - (a.s / a.n) * (b.s / b.n) as c from cols a join cols b using (model) where a.i < {NX} or a.i = b.i),
sc as materialized (select model, i, mi, case when i < {NX} then case when c > 1e-12 * greatest(1, mi * mi) then 1 / sqrt(c) else 0 end else 1 end as w, c from cov where i = j),
own as (select v.model, v.i, list(v.c * a.w * b.w + case when v.i = v.j then 1e-3 else 0 end order by v.j) as r
  from cov v join sc a on a.model = v.model and a.i = v.i join sc b on b.model = v.model and b.i = v.j where v.i < {NX} group by 1, 2),
steps(model, k, m) as (
  select model, 0, list(r order by i) from own group by 1
  union all
  select model, k + 1, list_transform(m, lambda r, i: case when i = k + 1 then list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1])
    else list_transform(r, lambda v, j: v - r[k + 1] * (m[k + 1][j] / m[k + 1][k + 1])) end) from steps where k < {NX}),
coef as (select model, i, unnest(range({NY})) as t, unnest(r[{NX + 1}:]) as b from (
  select model, unnest(m) as r, unnest(range({NX})) as i from steps where k = {NX})),
fit as (select model, t, list(b * w order by i) as co, sum(b * w * mi) as shift, sum(b * v.c * w + 1e-3 * b * b) as explained
  from coef join sc using (model, i) join (select model, i, j - {NX} as t, c from cov where i < {NX} and j >= {NX}) v using (model, i, t) group by 1, 2),
fits as (select f.model, f.t, co, s.mi - shift as a, greatest(s.c - explained, 0) as rest from fit f join sc s on s.model = f.model and s.i = f.t + {NX}),
lw as materialized (select model, list(co order by t) as co, list(a order by t) as a, list(factor order by t) as factor from (
  select *, sqrt(1.0 / (avg(rest) over (partition by model, t // 10) + 1e-3)) as factor from fits) group by 1),
mut as (select model, disk_id, end_day, split, y, list_transform(f, lambda v, t: (v - (a[t] + list_dot_product(x, co[t]))) * factor[t]) as v from vecs join lw using (model))"""


def mutated(spark, sf):
    rows = MU.with_history(marked(spark, sf), FEATURES).filter(F.col("split").isNotNull())
    fits = materialize(MU.fit_forecast(rows.filter("split = 'train' and y = 0"), FEATURES, ["model"]), "forecast")
    return MU.mutation_vectors(rows, fits, ["model"]).withColumnRenamed("day", "end_day")


@query("x7_mutation_features", f"{MUT} select {WKEY}, {cells_sql('v', 100)} as cells from mut")
def x7(spark, sf):
    return wkey(mutated(spark, sf), cells(F.col("mutation"), 100).alias("cells"))


def vote_sql() -> str:
    """Votes from ``pairs`` (q, y, dist): the five nearest, exact hits first."""
    return f"""
near as (select *, row_number() over (partition by q order by dist, y) as rk from pairs),
vote as (select q, case when min(dist) = 0 then count(*) filter (where dist = 0 and y = 1) / count(*) filter (where dist = 0)
  else sum(case when y = 1 then 1 / dist else 0 end) / sum(1 / dist) end as score from near where rk <= 5 group by 1)"""


KNN = MUT + f""",
tcnt as (select model, sum(y)::bigint as nf, sum(1 - y)::bigint as nh from mut where split = 'train' group by 1),
tr as (select * from (select m.*, nf, nh, row_number() over (partition by model, y order by {h(0)}, disk_id, end_day) as rk from mut m join tcnt using (model) where split = 'train') where rk <= least(nf, nh)),
pairs as (select struct_pack(model := model, disk_id := t.disk_id, end_day := t.end_day) as q, tr.y, round(list_distance(t.v, tr.v), 9) as dist
  from mut t join tr using (model) where t.split = 'test'),{vote_sql()}"""


@query("c7_neighbour_vote", f"{KNN} select q.model as model, q.disk_id as disk_id, strftime(q.end_day, '%Y-%m-%d') as end_day, {r6('score')} as score from vote")
def c7(spark, sf):
    rows = materialize(mutated(spark, sf).select("model", "disk_id", "end_day", "split", "y", "mutation"), "mutation")
    train = R.one_to_one(rows.filter("split = 'train'"), ["model"], KEYS, 0)
    scored = NB.knn_vote(train, rows.filter("split = 'test'").drop("y"), "mutation", ["model"])
    return wkey(scored, F.round("score", 6).alias("score"))


EMB_PAIRS = f"pairs as (select e.vec_id as q, t.quality as y, round(list_distance(e.embedding::double[], t.embedding::double[]), 9) as dist from embeddings e, (select embedding, quality from embeddings join labels on vec_id = doc_id) t where e.vec_id not in (select doc_id from labels)),{vote_sql()}"


@query("j11_nearest_neighbours", f"with {EMB_PAIRS} select q as vec_id, {r6('score')} as score from vote")
def j11(spark, sf):
    vecs = X.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    labels = X.table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("y"))
    train, rest = vecs.join(labels, "vec_id"), vecs.join(labels, "vec_id", "left_anti")
    return NB.knn_vote(train, rest, "v").select("vec_id", F.round("score", 6).alias("score"))


# ---- classifiers: one per model, trained 1:1 on train windows; the threshold is chosen on the 1:1 part of the validation windows ----

STATS = FX.statistic_columns(FEATURES)
VIEW_WIDTHS = {"raw": len(FEATURES), "hist": len(FEATURES) * HISTOGRAM_BINS, "seq": len(FEATURES) * 12}
VIEW_WIDTHS["comb"] = sum(VIEW_WIDTHS.values())


def evaluated(rows, scorer, kind: str, pick=M.best_f1):
    """Rates on all validation windows, on the 1:1 part of the test windows and on all of them; 0.5 where no threshold can be chosen.

    Only these are scored: a filter behind a scorer's Arrow batches would not be moved before them.
    """
    scored = scorer(rows.filter("split <> 'train'"))
    rows = materialize(scored.select("model", "disk_id", "end_day", "split", "y", "score"), "scores")
    even = R.one_to_one(rows, ["model", "split"], KEYS, 0)
    best = pick(M.grid_scores(even.filter("split = 'val'"), ["model"], "score", "y"), ["model"])
    thresholds = rows.select("model").distinct().join(best.select("model", "thr"), "model", "left").fillna(0.5, ["thr"])
    parts = rows.withColumn("part", F.col("split")).unionByName(even.filter("split = 'test'").withColumn("part", F.lit("test 1:1")))
    pred = M.apply_threshold(parts, materialize(thresholds, "thresholds"), ["model"], "score")
    return M.with_rates(M.confusion(pred, ["model", "part"], "y", "pred_status")).withColumn("classifier", F.lit(kind))


def flat(wins):
    return wins.select("model", "disk_id", "end_day", "split", "y", S.flatten_day_major([F.col(c) for c in FEATURES]).alias("x"))


def flat_windows(spark, sf):
    return materialize(flat(windows(spark, sf)), "flat-windows")


def sampled_train(rows):
    return R.one_to_one(rows.filter("split = 'train'"), ["model"], KEYS, 0)


def balanced_train(rows):
    return materialize(sampled_train(rows), "train")


@query("c1_forest")
def c1(spark, sf):
    wins = windows(spark, sf)
    train = materialize(flat(sampled_train(wins)), "train")
    rows = materialize(flat(wins.filter("split <> 'train'")), "flat-windows")
    return evaluated(rows, MD.forest_scorer(train, ["model"], "x", 30 * len(FEATURES), ["model", *KEYS]), "forest")


def scaled_windows(rows, train, by):
    learned = SC.minmax_ranges(train.withColumn("vec", array_to_vector("x")), "vec", by)
    return materialize(SC.minmax_scale(rows, learned, "x", by, "z").drop("x"), "scaled")


@query("c2_perceptron")
def c2(spark, sf):
    rows = flat_windows(spark, sf)
    scaled = scaled_windows(rows, rows.filter("split = 'train'"), ["model"])
    return evaluated(scaled, MD.perceptron_scorer(balanced_train(scaled), ["model"], "z", 30 * len(FEATURES), ["model", *KEYS]), "perceptron")


def statistic_rows(spark, sf):
    rows = windows_of_stats(spark, sf)
    return materialize(rows.select("model", "disk_id", "end_day", "split", "y", F.array(*STATS).alias("x")), "stats")


def windows_of_stats(spark, sf):
    stats = FX.frame_statistics(X.imputed(spark, sf), FEATURES)
    lab = W.label_windows(stats, W.earliest_failures(X.failure_tags(spark, sf)))
    return W.split_windows(lab, W.month_index(X.telemetry(spark, sf)), RULE, (1,))


@query("c3_boosted_trees")
def c3(spark, sf):
    rows = statistic_rows(spark, sf)
    return evaluated(rows, MD.boosted_scorer(balanced_train(rows), ["model"], "x", len(STATS), ["model", *KEYS]), "boosted", M.best_precision)


@query("c4_statistics_forest")
def c4(spark, sf):
    rows = statistic_rows(spark, sf)
    scorer = MD.forest_scorer(balanced_train(rows), ["model"], "x", len(STATS), ["model", *KEYS], depth=9)
    return evaluated(rows, scorer, "statistics-forest", M.best_precision)


@query("c5_multi_view_forest")
def c5(spark, sf):
    wins = windows(spark, sf)
    learned = materialize(ranges(wins), "ranges")

    def views_of(some, name):
        views = FX.four_views(FX.with_sequences(some, FEATURES), learned, FEATURES, ["model"])
        return materialize(views.select("model", "disk_id", "end_day", "split", "y", *[vector_to_array(v).alias(v) for v in MD.VIEWS]), name)

    scorer = MD.multi_view_scorer(views_of(sampled_train(wins), "train"), ["model"], VIEW_WIDTHS, ["model", *KEYS])
    return evaluated(views_of(wins.filter("split <> 'train'"), "views"), scorer, "multi-view", M.best_precision)


@query("c6_p8_reconstruction")
def c6(spark, sf):
    rows = flat_windows(spark, sf)
    scaled = scaled_windows(rows, rows.filter("split = 'train' and y = 0"), ["model"])
    scorer = MD.reconstruction_scorer(scaled.filter("split = 'train' and y = 0"), ["model"], "z", 30 * len(FEATURES))
    scored = materialize(scorer(scaled.filter("split <> 'train'")).drop("z"), "scores")  # a filter behind the scorer's batches would not be moved before them
    thr = M.curve_threshold(scored.filter("split = 'val'"), ["model"], "score", "y")
    pred = M.apply_threshold(scored.filter("split = 'test'"), thr, ["model"], "score")
    return M.with_rates(M.confusion(pred, ["model"], "y", "pred_status")).withColumn("classifier", F.lit("reconstruction"))


@query("score_with_user_model", f"with {WIN} select {WKEY}, {r6('list_max(r_5) / (list_max(r_5) + 50.0)')} as score from win")
def user_model(spark, sf):
    rows = windows(spark, sf).select("model", "disk_id", "end_day", F.array_max("r_5").alias("top"))
    scored = MD.score_with(rows, lambda batch: batch["top"] / (batch["top"] + 50.0))
    return wkey(scored, F.round("score", 6).alias("score"))


# ---- sweeps -----------------------------------------------------------------------------------

SIZES = [10, 20, 30, 40, 50]
SWEEP = " union all ".join(
    f"select 'window' as study, {n} as window_days, 5 as patch_len, {n // 5} as patches, model, count(*) as windows from (select model, count(*) over (partition by model, disk_id order by day rows between {n - 1} preceding and current row) as n from tel) where n = {n} group by model"
    for n in SIZES) + " union all " + " union all ".join(
    f"select 'patch', 30, {p}, {30 // p}, model, count(*) from (select model, count(*) over (partition by model, disk_id order by day rows between 29 preceding and current row) as n from tel) where n = 30 group by model"
    for p in (2, 4, 5, 10, 15))


@query("m11_u7_parameter_sweep", f"with {X.TELEMETRY} {SWEEP}")
def m11(spark, sf):
    grid = P.settings(spark, "window", [10, 20, 40, 50]).unionByName(P.settings(spark, "patch", [2, 4, 10, 15]))
    return PS.window_counts(X.telemetry(spark, sf), grid)


def run_sql(size: int, days: int) -> str:
    """Rates of one setting from its own windows: every window cut into patches, nothing shared with other settings."""
    zs = ", ".join(f"list_transform({c}[p * {days} + 1 : p * {days} + {days}], lambda v: (v - m_{c}) / s_{c}) as z_{c}" for c in FEATURES)
    each_attr = " union all ".join(f"select model, disk_id, end_day, split, y, {k} as k, z_{c} as z from wp" for k, c in enumerate(FEATURES))

    def centers(src: str, k: str) -> str:
        return f"""(select model, list(c order by k) as cs from (select model, k, list(v order by i) as c from (
  select model, k, i, round(avg(v), 6) as v from (select model, {k} as k, unnest(z) as v, unnest(range(len(z))) as i from {src} where split = 'train') group by 1, 2, 3)
  group by 1, 2) group by 1)"""

    return f"""with {X.windows_sql(size)},
vals as ({' union all '.join(f"select model, '{c}' as attr, unnest({c}) as v from win where split = 'train'" for c in FEATURES)}),
scaler as (select model, attr, avg(v) as mean, stddev_pop(v) + 1e-6 as std from vals group by 1, 2),
{SROW},
wp as materialized (select model, disk_id, end_day, split, y, p, {zs} from win join srow using (model), (select unnest(range({size // days})) as p)),
ap as ({each_attr}), cp as (select model, disk_id, end_day, split, y, {' || '.join(f'z_{c}' for c in FEATURES)} as z from wp),
acent as {centers('ap', 'k')}, ccent as {centers('cp', 'y')},
am as materialized (select model, disk_id, end_day, split, y, list_min(list_transform(cs, lambda c: list_distance(c, z))) as dist from ap join acent using (model)),
cm as materialized (select model, disk_id, end_day, split, y, list_min(list_transform(cs, lambda c: list_distance(c, z))) as dist from cp join ccent using (model)),
{tuned_sql('am', 'at')}, {tuned_sql('cm', 'ct')},
na as (select model, split, count(*) filter (where dist > threshold) as attr_novel from am join at_t using (model) group by 1, 2),
nc as (select model, disk_id, end_day, split, y, count(*) filter (where dist > threshold) as n from cm join ct_t using (model) group by all),
conf as (select model, split, count(*) as windows, cast(sum(n) as bigint) as cross_novel, count(*) filter (where y = 1 and n > 0) as tp, count(*) filter (where y = 0 and n > 0) as fp,
  count(*) filter (where y = 0 and n = 0) as tn, count(*) filter (where y = 1 and n = 0) as fn from nc group by 1, 2),
{X.rates_sql('conf', 'model, split, windows, cross_novel', 'rated')}
select {size} as window_days, {days} as patch_len, {size // days} as patches, model, split, windows, attr_novel, cross_novel, tp, fp, tn, fn,
  {', '.join(f'{r6(c)} as {c}' for c in P.STATUS_METRICS)} from rated join na using (model, split)"""


RUNS = [(n, 5) for n in SIZES] + [(30, p) for p in (2, 4, 10, 15)]


@query("m11_sweep_rates", f"""with runs as materialized ({' union all '.join(f'select * from ({run_sql(n, p)})' for n, p in RUNS)})
select 'window' as study, * from runs where patch_len = 5 union all select 'patch', * from runs where window_days = 30""")
def m11_rates(spark, sf):
    """Ten settings of two studies, nine runs: each learns its scaler, prototypes and thresholds and flags its own windows."""
    grid = P.settings(spark, "window", [10, 20, 40, 50]).unionByName(P.settings(spark, "patch", [2, 4, 10, 15]))
    runs = PS.listed(grid)
    rates = PS.setting_rates(PS.run_settings(X.imputed(spark, sf), X.failure_tags(spark, sf), RULE, FEATURES, runs), grid, runs)
    return rates.select("study", "window_days", "patch_len", "patches", "model", "split", "windows", "attr_novel", "cross_novel", *M.COUNTS,
                        *[F.round(c, 6).alias(c) for c in P.STATUS_METRICS])


SENS = X.ANSWERS + f""", {X.CONF},
st as (select 'window' as study, 10 + 20 * (round - 1) as window_days, 5 as patch_len, method, backbone, dataset, tp, fp, tn, fn from conf),
{X.rates_sql('st', 'study, window_days, patch_len, method, backbone, dataset', 'sr')}"""


def sensitivity(spark, sf):
    """Rounds of the answers stand for the settings N = 10, 30, 50."""
    c = M.with_rates(M.confusion(X.predictions(spark, sf), ["method", "backbone", "dataset", "round"]))
    named = c.select(F.lit("window").alias("study"), (10 + 20 * (F.col("round") - 1)).alias("window_days"), F.lit(5).alias("patch_len"),
                     "method", "backbone", "dataset", *P.STATUS_METRICS)
    wide = P.to_wide(named, ["study", "window_days", "patch_len", "method", "backbone"], ["MB1", "MB2"])
    return P.sensitivity_long(wide, ["MB1", "MB2"])


@query("m10_sensitivity_long", f"with {SENS} select study, window_days, patch_len, method, backbone, dataset, {', '.join(f'{r6(m)} as {m}' for m in P.STATUS_METRICS)}, case when window_days = 30 and patch_len = 5 then 1 else 0 end as is_baseline from sr")
def m10(spark, sf):
    s = sensitivity(spark, sf)
    return s.select("study", "window_days", "patch_len", "method", "backbone", "dataset",
                    *[F.round(m, 6).alias(m) for m in P.STATUS_METRICS], F.col("is_baseline").cast("int").alias("is_baseline"))


@query("a21_sensitivity_means", f"with {SENS} select study, dataset, method, backbone, {', '.join(f'{r6(f"avg({m})")} as {m}' for m in P.STATUS_METRICS)} from sr group by 1, 2, 3, 4")
def a21(spark, sf):
    m = P.sensitivity_means(sensitivity(spark, sf))
    return m.select("study", "dataset", "method", "backbone", *[F.round(x, 6).alias(x) for x in P.STATUS_METRICS])
