"""Series functions, feature views and scalers over the whole window table."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fleetpulse.functions import series as S, trends as T
from fleetpulse.functions.text import three_digits, whole_numbers
from fleetpulse.operators import features as FX, scaling as SC, windows as W
from fleetpulse.registry import fixtures as X
from fleetpulse.registry.catalog import query
from fleetpulse.registry.fixtures import FEATURES, RULE, r6
from fleetpulse.registry.queries_data import WKEY, windows, wkey

WIN = X.WINDOWS


def rounded(df, cols):
    return [F.round(c, 6).alias(c) for c in cols]


def each(make) -> str:
    """The SQL columns that ``make`` gives for every attribute."""
    return ", ".join(make(c) for c in FEATURES)


def cells_sql(values: str, scale: int = 1) -> str:
    """A list as text, so that one row shows all its values: whole numbers of ``1 / scale``."""
    return f"array_to_string(list_transform({values}, lambda v: cast(round(v * {scale}) as bigint)::varchar), ',')"


def cells(values, scale: int = 1, shift: float = 0.0):
    return whole_numbers(values, scale, shift)


def every(make):
    """The columns that ``make`` gives for every attribute, as one list."""
    return [made for c in FEATURES for made in make(c)]


@query("w6_step_differences", f"""with {WIN} select {WKEY}, {each(lambda c: f"list_sum(list_transform(range(2, 31), lambda i: abs({c}[i] - {c}[i - 1]))) as {c}_total, list_max(list_transform(range(2, 31), lambda i: {c}[i] - {c}[i - 1])) as {c}_top")} from win""")
def w6(spark, sf):
    def steps(c):
        d = S.diffs(F.col(c))
        return [S.total(F.transform(d, F.abs)).alias(f"{c}_total"), F.array_max(d).alias(f"{c}_top")]

    return wkey(windows(spark, sf), *every(steps))


@query("w7_first_last", f"with {WIN} select {WKEY}, {each(lambda c: f'{c}[1] as {c}_first, {c}[30] as {c}_last, {c}[30] - {c}[1] as {c}_delta')} from win")
def w7(spark, sf):
    def ends(c):
        x = F.col(c)
        return [S.first(x).alias(f"{c}_first"), S.last(x).alias(f"{c}_last"), (S.last(x) - S.first(x)).alias(f"{c}_delta")]

    return wkey(windows(spark, sf), *every(ends))


@query("w8_segments", f"""with {WIN} select {WKEY}, g, {each(lambda c: f"list_sum({c}[(g * 30) // 4 + 1 : ((g + 1) * 30) // 4]) as {c}")}, ((g + 1) * 30) // 4 - (g * 30) // 4 as days
from win, (select unnest(range(0, 4)) as g)""")
def w8(spark, sf):
    parts = F.array(*[F.struct(F.lit(g).alias("g"), *[S.segment(F.col(c), g, 4).alias(c) for c in FEATURES]) for g in range(4)])
    rows = windows(spark, sf).withColumn("p", F.explode(parts))
    return wkey(rows, F.col("p.g").alias("g"), *[S.total(F.col(f"p.{c}")).alias(c) for c in FEATURES], F.size("p.r_5").alias("days"))


@query("w9_patches_with_tail", f"""with {X.windows_sql(size=17)} select {WKEY}, p, {each(lambda c: f"list_sum({c}[p * 5 + 1 : p * 5 + 5]) as {c}")}
from win, (select unnest(range(0, 3)) as p)""")
def w9(spark, sf):
    # 17 days and patches of 5: two trailing days are dropped
    wins = W.build_windows(X.telemetry(spark, sf), X.failure_tags(spark, sf), FEATURES, RULE, size=17, rounds=(1,))
    cut = wins.select("model", "disk_id", "end_day", F.arrays_zip(*[S.patches(F.col(c), 5).alias(c) for c in FEATURES]).alias("z"))
    rows = cut.select("model", "disk_id", "end_day", F.posexplode("z").alias("p", "patch"))
    return wkey(rows, "p", *[S.total(F.col(f"patch.{c}")).alias(c) for c in FEATURES])


W10_PARTS = " union all ".join(f"select model, disk_id, end_day, '{c}' as attr, i, {c}[i + 1 : i + 5] as patch from win, (select unnest(range(0, 26)) as i) where split = 'train'" for c in FEATURES)


@query("w10_random_patches", f"""with {WIN}, parts as ({W10_PARTS}),
pos as (select *, md5('11|' || disk_id || '|' || strftime(end_day, '%Y-%m-%d') || '|' || attr || '|' || i) as h from parts)
select {WKEY}, attr, i as pos, list_sum(patch) as total from (select *, row_number() over (partition by model order by h, disk_id, end_day, attr, i) as rk from pos) where rk <= 2000""")
def w10(spark, sf):
    from fleetpulse.operators.sampling import capped

    def patches_of(c):
        return F.transform(S.all_patches(F.col(c), 5), lambda p: F.struct(F.lit(c).alias("attr"), p["pos"].alias("pos"), p["patch"].alias("patch")))

    items = F.concat(*[patches_of(c) for c in FEATURES])
    train = windows(spark, sf).filter("split = 'train'").select("model", "disk_id", "end_day", F.explode(items).alias("p"))
    chosen = capped(train.select("model", "disk_id", "end_day", "p.*"), ["model"], ["disk_id", "end_day", "attr", "pos"], 2000, 11)
    return wkey(chosen, "attr", "pos", S.total(F.col("patch")).alias("total"))


@query("w11_edge_means", f"with {WIN} select {WKEY}, {each(lambda c: r6(f'list_sum({c}[1:10]) / 10') + f' as {c}_early, ' + r6(f'list_sum({c}[21:30]) / 10') + f' as {c}_late')} from win")
def w11(spark, sf):
    def edges(c):
        e = S.edge_means(F.col(c))
        return [F.round(e["early"], 6).alias(f"{c}_early"), F.round(e["late"], 6).alias(f"{c}_late")]

    return wkey(windows(spark, sf), *every(edges))


@query("w12_history_horizon", f"with {WIN} select {WKEY}, {each(lambda c: f'list_sum({c}[1:20]) as {c}_history, list_sum({c}[21:30]) as {c}_horizon')} from win")
def w12(spark, sf):
    def parts(c):
        p = S.history_and_horizon(F.col(c))
        return [S.total(p["history"]).alias(f"{c}_history"), S.total(p["horizon"]).alias(f"{c}_horizon")]

    return wkey(windows(spark, sf), *every(parts))


@query("w13_cross_patches", f"""with {WIN} select {WKEY}, p, {cells_sql("list_concat(" * (len(FEATURES) - 1) + FEATURES[0] + "[p * 5 + 1 : p * 5 + 5]" + "".join(f", {c}[p * 5 + 1 : p * 5 + 5])" for c in FEATURES[1:]))} as cells
from win, (select unnest(range(0, 6)) as p)""")
def w13(spark, sf):
    rows = windows(spark, sf).select("model", "disk_id", "end_day", F.posexplode(
        S.cross_patches([F.col(c) for c in FEATURES], 5)).alias("p", "patch"))
    return wkey(rows, "p", cells(F.col("patch")).alias("cells"))


STAT_NAMES = ["level_mean", "level_std", "delta", "amp", "max_step", "mean_abs_step", "step_std", "pos_max_step"]


def v1_sql(c: str) -> str:
    return f"""30 as "{c}_L", {r6(f'list_sum({c}) / 30')} as {c}_level_mean,
  {r6(f'sqrt(list_sum(list_transform({c}, lambda x: (x - list_sum({c}) / 30) * (x - list_sum({c}) / 30))) / 30)')} as {c}_level_std,
  {c}[30] - {c}[1] as {c}_delta, list_max({c}) - list_min({c}) as {c}_amp, list_max(ad_{c}) as {c}_max_step, {r6(f'list_sum(ad_{c}) / 29')} as {c}_mean_abs_step,
  {r6(f'sqrt(list_sum(list_transform(d_{c}, lambda x: (x - list_sum(d_{c}) / 29) * (x - list_sum(d_{c}) / 29))) / 29)')} as {c}_step_std,
  {r6(f'(list_position(ad_{c}, list_max(ad_{c})) - 1) / 29')} as {c}_pos_max_step"""


@query("v1_series_stats", f"""with {WIN}, st as (select *, {each(lambda c: f"list_transform(range(2, 31), lambda i: {c}[i] - {c}[i - 1]) as d_{c}")} from win),
sa as (select *, {each(lambda c: f"list_transform(d_{c}, lambda x: abs(x)) as ad_{c}")} from st)
select {WKEY}, {each(v1_sql)} from sa""")
def v1(spark, sf):
    rows = windows(spark, sf).withColumns({f"s_{c}": S.series_stats(F.col(c)) for c in FEATURES})
    return wkey(rows, *every(lambda c: [F.col(f"s_{c}.L").alias(f"{c}_L"), *[F.round(f"s_{c}.{n}", 6).alias(f"{c}_{n}") for n in STAT_NAMES]]))


@query("v2_span_stats", f"""with {WIN} select {WKEY}, {each(lambda c: f"list_min({c}) as {c}_lo, list_max({c}) as {c}_hi, {r6(f'list_sum({c}) / 30')} as {c}_mean, {c}[1] as {c}_first, {c}[30] as {c}_last, {c}[30] - {c}[1] as {c}_delta")} from win""")
def v2(spark, sf):
    rows = windows(spark, sf).withColumns({f"s_{c}": S.span_stats(F.col(c)) for c in FEATURES})
    return wkey(rows, *every(lambda c: [
        F.col(f"s_{c}.min").alias(f"{c}_lo"), F.col(f"s_{c}.max").alias(f"{c}_hi"), F.round(f"s_{c}.mean", 6).alias(f"{c}_mean"),
        F.col(f"s_{c}.first").alias(f"{c}_first"), F.col(f"s_{c}.last").alias(f"{c}_last"), F.col(f"s_{c}.delta").alias(f"{c}_delta")]))


@query("v3_range_positives_argmax", f"""with {WIN} select {WKEY}, {each(lambda c: f"list_max({c}) - list_min({c}) as {c}_spread, len(list_filter({c}, lambda x: x > 0)) as {c}_positives, list_position({c}, list_max({c})) - 1 as {c}_top_at")} from win""")
def v3(spark, sf):
    def parts(c):
        x = F.col(c)
        return [(F.array_max(x) - F.array_min(x)).alias(f"{c}_spread"), F.size(F.filter(x, lambda v: v > 0)).alias(f"{c}_positives"),
                S.arg_first(x, F.array_max(x)).alias(f"{c}_top_at")]

    return wkey(windows(spark, sf), *every(parts))


@query("v4_flatten_day_major", f"""with {WIN} select {WKEY}, {cells_sql("list_transform(range(0, 120), lambda i: case i % 4 when 0 then r_5[i // 4 + 1] when 1 then r_187[i // 4 + 1] when 2 then r_197[i // 4 + 1] else r_241[i // 4 + 1] end)")} as cells from win""")
def v4(spark, sf):
    return wkey(windows(spark, sf), cells(S.flatten_day_major([F.col(c) for c in FEATURES])).alias("cells"))


@query("v6_checked_window", f"with {WIN} select split, count(*) as n, {each(lambda c: f'count(*) as {c}_five, 0 as {c}_four, sum(list_sum({c})) as {c}')} from win group by 1")
def v6(spark, sf):
    rows = windows(spark, sf).withColumns({f"{c}_{name}": S.checked_window(F.col(c), days, n) for c in FEATURES for name, days, n in (("five", 5, 6), ("four", 4, 7))})
    return rows.groupBy("split").agg(F.count("*").alias("n"), *every(lambda c: [
        F.count(f"{c}_five").alias(f"{c}_five"), F.count(f"{c}_four").alias(f"{c}_four"), F.sum(S.total(F.col(f"{c}_five"))).alias(c)]))


X1_SQL = ", ".join(f"""min({c}) over w as {c}_min, max({c}) over w as {c}_max, avg({c}) over w as {c}_mean, stddev_pop({c}) over w as {c}_std,
  first_value({c}) over w as {c}_first, {c} as {c}_last, {c} - first_value({c}) over w as {c}_delta, ({c} - first_value({c}) over w) / 29 as {c}_mean_diff""" for c in FEATURES)
X1_COLS = FX.statistic_columns(FEATURES)


@query("x1_frame_statistics", f"""with {X.IMPUTED}, s as (select model, disk_id, day as end_day, count(*) over w as n, {X1_SQL} from imp
  window w as (partition by model, disk_id order by day rows between 29 preceding and current row))
select {WKEY}, {', '.join(f'{r6(c)} as {c}' for c in X1_COLS)} from s where n = 30""")
def x1(spark, sf):
    rows = FX.frame_statistics(X.imputed(spark, sf), FEATURES)
    return wkey(rows, *rounded(rows, X1_COLS))


@query("x2_last_day", f"with {WIN} select {WKEY}, {', '.join(f'{c}[30] as {c}_raw' for c in FEATURES)} from win")
def x2(spark, sf):
    return wkey(FX.last_day(windows(spark, sf), FEATURES), *[f"{c}_raw" for c in FEATURES])


RANGES = WIN + ", rng as (select model, " + ", ".join(
    f"min(list_min({c})) as {c}_lo, case when max(list_max({c})) = min(list_min({c})) then min(list_min({c})) + 1 else max(list_max({c})) end as {c}_hi"
    for c in FEATURES) + " from win where split = 'train' group by 1)"


def ranges(wins):
    return FX.value_ranges(wins.filter("split = 'train'"), FEATURES, ["model"])


@query("a9_value_ranges", f"with {RANGES} select model, {', '.join(f'{c}_lo as {c}_low, {c}_hi as {c}_high' for c in FEATURES)} from rng")
def a9(spark, sf):
    return ranges(windows(spark, sf))


@query("x3_histogram_edges", f"""with {RANGES} select model, i, {', '.join(f'{r6(f"{c}_lo + ({c}_hi - {c}_lo) * i / 50")} as {c}' for c in FEATURES)} from rng, (select unnest(range(0, 51)) as i)""")
def x3(spark, sf):
    edges = FX.histogram_edges(ranges(windows(spark, sf)), FEATURES, ["model"])
    zipped = edges.select("model", F.posexplode(F.arrays_zip(*FEATURES)).alias("i", "e"))
    return zipped.select("model", "i", *[F.round(f"e.{c}", 6).alias(c) for c in FEATURES])


def bins_sql(c: str, bins: int = 50) -> str:
    """Days per bin as text; a window holds whole days, so its shares are these counts over 30."""
    at = f"list_transform(list_filter({c}, lambda v: v >= {c}_lo), lambda v: least({bins - 1}, floor((v - {c}_lo) / ({c}_hi - {c}_lo) * {bins})))"
    return f"array_to_string(list_transform(range(0, {bins}), lambda b: len(list_filter({at}, lambda x: x = b))::varchar), ',') as {c}"


def bin_days(shares):
    return cells(shares, 30)


@query("x4_j5_histogram", f"with {RANGES} select {WKEY}, {each(bins_sql)} from win join rng using (model)")
def x4(spark, sf):
    wins = windows(spark, sf)
    hist = FX.histogram_view(wins, ranges(wins), FEATURES, ["model"])
    return wkey(hist, *[bin_days(F.col(f"{c}_hist")).alias(c) for c in FEATURES])


def segment_sql(c: str, g: int) -> str:
    """[variation, kurtosis, slope] of a part; the small shift keeps exact ties of the last digit on one side in both engines."""
    a, b = g * 30 // 4, (g + 1) * 30 // 4
    s, n = f"{c}[{a + 1}:{b}]", b - a
    m = f"(list_sum({s}) / {n})"
    m2 = f"(list_sum(list_transform({s}, lambda x: (x - {m}) * (x - {m}))) / {n})"
    m4 = f"(list_sum(list_transform({s}, lambda x: (x - {m}) * (x - {m}) * (x - {m}) * (x - {m}))) / {n})"
    return (f"case when abs({m}) > 1e-8 then sqrt({m2}) / {m} else 0.0 end + 3e-10, "
            f"case when {m2} > 1e-8 then {m4} / ({m2} * {m2}) - 3.0 else 0.0 end + 3e-10, ({c}[{b}] - {c}[{a + 1}]) / {n - 1} + 3e-10")


def sequence_sql(c: str) -> str:
    return cells_sql("[" + ", ".join(segment_sql(c, g) for g in range(4)) + "]", 1000000) + f" as {c}"


def sequence_cells(values):
    return cells(values, 1000000, 3e-10)


@query("x5_sequence", f"with {WIN} select {WKEY}, {each(sequence_sql)} from win")
def x5(spark, sf):
    rows = windows_of(spark, sf, FX.sequence_frames(X.imputed(spark, sf), FEATURES))
    return wkey(rows, *[sequence_cells(F.col(f"{c}_seq")).alias(c) for c in FEATURES])


def windows_of(spark, sf, rows, features=()):
    """Labelled windows of already imputed rows; the other columns are carried along."""
    wins = W.row_windows(rows, list(features))
    lab = W.label_windows(wins, W.earliest_failures(X.failure_tags(spark, sf)))
    return W.split_windows(lab, W.month_index(X.telemetry(spark, sf)), RULE, (1,))


@query("x5_segment_function", f"with {WIN} select {WKEY}, {each(sequence_sql)} from win")
def x5b(spark, sf):
    def parts(c):
        made = [S.segment_features(S.segment(F.col(c), g, 4)) for g in range(4)]
        return [sequence_cells(F.array(*[f[n] for f in made for n in ("cv", "kurtosis", "slope")])).alias(c)]

    return wkey(windows(spark, sf), *every(parts))


@query("x6_four_views", f"""with {RANGES}, bins as (select win.*, {each(bins_sql).replace(" as r_", " as hist_r_")} from win join rng using (model)),
seqs as (select *, {each(sequence_sql).replace(" as r_", " as seq_r_")} from bins)
select {WKEY}, {cells_sql(f"[{each(lambda c: f'{c}[30]')}]")} as raw, concat_ws(',', {each(lambda c: f'hist_{c}')}) as hist,
  concat_ws(',', {each(lambda c: f'seq_{c}')}) as seq, 252 as width, true as all_three from seqs""")
def x6(spark, sf):
    wins = windows(spark, sf)
    views = FX.four_views(FX.with_sequences(wins, FEATURES), ranges(wins), FEATURES, ["model"])
    raw, hist, seq, comb = (vector_to_array(F.col(c)) for c in ("raw", "hist", "seq", "comb"))
    return wkey(views, cells(raw).alias("raw"), bin_days(hist).alias("hist"), sequence_cells(seq).alias("seq"),
                F.size(comb).alias("width"), (comb == F.concat(raw, hist, seq)).alias("all_three"))


def marked(spark, sf):
    """Imputed daily rows with ``split`` of the window that ends there, null when none does."""
    daily = X.imputed(spark, sf)
    return W.mark_windows(daily, X.failure_tags(spark, sf), RULE)


SCALER_SQL = WIN + ", vals as (" + " union all ".join(
    f"select model, '{c}' as attr, unnest({c}) as v from win where split = 'train'" for c in FEATURES) + """),
scaler as (select model, attr, avg(v) as mean, stddev_pop(v) + 1e-6 as std from vals group by 1, 2)"""


def scaler(spark, sf):
    rows = SC.train_cover(marked(spark, sf), F.col("split") == "train")
    return SC.window_scaler(rows, FEATURES, ["model"])


@query("a6_train_scaler", f"with {SCALER_SQL} select model, attr, {r6('mean')} as mean, {r6('std')} as std from scaler")
def a6(spark, sf):
    return scaler(spark, sf).select("model", "attr", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("j6_standardize", f"""with {SCALER_SQL}, wide as (select model, {each(lambda c: f"max(case when attr = '{c}' then mean end) as m_{c}, max(case when attr = '{c}' then std end) as s_{c}")} from scaler group by 1)
select model, disk_id, strftime(day, '%Y-%m-%d') as day, {each(lambda c: r6(f'({c} - m_{c}) / s_{c}') + f' as z_{c}')} from imp join wide using (model)""")
def j6(spark, sf):
    z = SC.standardize(X.imputed(spark, sf), scaler(spark, sf), FEATURES, ["model"])
    return z.select("model", "disk_id", F.col("day").cast("string").alias("day"), *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in FEATURES])


A7 = ["r_5_mean", "r_187_max", "r_241_delta"]


@query("a7_standardize_columns", f"""with {WIN}, f as (select *, list_sum(r_5) / 30 as r_5_mean, list_max(r_187) as r_187_max, r_241[30] - r_241[1] as r_241_delta from win),
st as (select model, {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in A7)} from f where split = 'train' group by 1)
select {WKEY}, {', '.join(f'{r6(f"({c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end")} as {c}' for c in A7)} from f join st using (model)""")
def a7(spark, sf):
    wins = windows(spark, sf).select("model", "disk_id", "end_day", "split", S.mean(F.col("r_5")).alias("r_5_mean"),
                                     F.array_max("r_187").alias("r_187_max"), (S.last(F.col("r_241")) - S.first(F.col("r_241"))).alias("r_241_delta"))
    z = SC.standardize_columns(wins, A7, ["model"], F.col("split") == "train")
    return wkey(z, *rounded(z, A7))


@query("a8_minmax_scale", f"""with {WIN}, st as (select model, {each(lambda c: ", ".join(f"min({c}[{i}]) as {c}_lo{i}, case when max({c}[{i}]) - min({c}[{i}]) < 1e-6 then 1.0 else max({c}[{i}]) - min({c}[{i}]) end as {c}_w{i}" for i in range(1, 31)))}
  from win where split = 'train' group by 1)
select {WKEY}, {each(lambda c: cells_sql("[" + ", ".join(f"({c}[{i}] - {c}_lo{i}) / {c}_w{i}" for i in range(1, 31)) + "]", 1000000) + f" as {c}")} from win join st using (model)""")
def a8(spark, sf):
    from pyspark.ml.functions import array_to_vector

    wins = windows(spark, sf).withColumns({f"vec_{c}": array_to_vector(c) for c in FEATURES})
    train, scaled = wins.filter("split = 'train'"), wins
    for c in FEATURES:
        scaled = SC.minmax_scale(scaled, SC.minmax_ranges(train, f"vec_{c}", ["model"]), c, ["model"], f"scaled_{c}")
    return wkey(scaled, *[cells(F.col(f"scaled_{c}"), 1000000).alias(c) for c in FEATURES])


@query("f26_three_digits", "select l_orderkey, l_linenumber, count(*) as n, min(printf('%.3g', l_extendedprice * l_discount)) as shown from lineitem group by 1, 2")
def f26(spark, sf):
    rows = X.table(spark, sf, "lineitem").withColumn("shown", three_digits(F.col("l_extendedprice") * F.col("l_discount")))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("shown").alias("shown"))


@query("f27_non_finite", """select event_type, count(*) as n, sum(case when event_id % 4 = 3 then cast(user_id as double) else 0 end) as total
from events group by 1""")
def f27(spark, sf):
    from fleetpulse.functions.scalars import finite_or_zero

    v = F.col("user_id").cast("double")
    broken = (F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 == 1, F.lit(float("inf")))
              .when(F.col("event_id") % 4 == 2, F.lit(None)).otherwise(v))
    rows = X.table(spark, sf, "events").withColumn("v", finite_or_zero(broken))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


# The heuristic rules in SQL, over the terms of one window.
C10_SQL = """
hterm as (select *, list_max(x) as hi, list_max(x) - list_min(x) as rng, list_sum(x) / 30 as mu, x[30] - x[1] as dl,
  len(list_filter(x, lambda v: v > 0)) as pos, list_sum(x[1:10]) / 10 as early, list_sum(x[21:30]) / 10 as late, list_position(x, list_max(x)) - 1 as top
  from hsrc),
hscale as (select *, greatest(abs(mu), abs(hi), 1.0) as sc from hterm),
heur as (select *, case
  when rng < 1e-3 and pos = 0 then 'mostly zero across 30 days'
  when rng < 0.01 * sc and pos = 0 then 'exactly zero across 30 days'
  when rng < 0.01 * sc then 'roughly constant at a small nonzero value'
  when dl > 0.2 * sc and late > early * 1.5 then case when rng > 0.5 * sc then 'steady increase with strong late growth' else 'steady increase over the window' end
  when dl < -0.2 * sc and early > late * 1.5 then 'monotonic decrease across the window'
  when rng > 0.5 * sc and abs(dl) < 0.2 * rng then case when top >= 20 then 'sharp late spike in the last 10 days'
    when top <= 10 then 'sharp early spike in the first 10 days' else 'sharp spikes in the middle of the window' end
  when pos = 0 then 'mostly zero with harmless fluctuations' else 'low but noisy with occasional small spikes' end as phrase from hscale)"""
HSRC = "hsrc as (" + " union all ".join(f"select model, disk_id, end_day, split, y, '{c}' as attr, {c} as x from win" for c in FEATURES) + ")"


@query("c10_window_phrase", f"with {WIN}, {HSRC}, {C10_SQL} select {WKEY}, attr, phrase from heur")
def c10(spark, sf):
    phrased = FX.frame_phrases(X.imputed(spark, sf), FEATURES)
    lab = W.label_windows(phrased, W.earliest_failures(X.failure_tags(spark, sf)))
    wins = W.split_windows(lab, W.month_index(X.telemetry(spark, sf)), RULE, (1,))
    rows = wins.select("model", "disk_id", "end_day", F.explode(F.array(*[
        F.struct(F.lit(c).alias("attr"), F.col(f"{c}_phrase").alias("phrase")) for c in FEATURES])).alias("p"))
    return wkey(rows, "p.attr", "p.phrase")


@query("c10_phrase_function", f"with {WIN}, {HSRC}, {C10_SQL} select {WKEY}, attr, phrase from heur")
def c10f(spark, sf):
    phrases = F.array(*[F.struct(F.lit(c).alias("attr"), T.window_phrase(F.col(c)).alias("phrase")) for c in FEATURES])
    rows = windows(spark, sf).select("model", "disk_id", "end_day", F.explode(phrases).alias("p"))
    return wkey(rows, "p.attr", "p.phrase")
