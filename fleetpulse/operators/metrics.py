"""Confusion counts, rates, thresholds and time-to-failure metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.fixed_values import THRESHOLD_GRID, TTF_BUCKETS
from fleetpulse.functions.scalars import bucket_midpoint, f_beta, let, safe_div, ttf_bucket
from fleetpulse.operators.ranking import exact_quantiles, running_totals
from fleetpulse.session import materialize

COUNTS = ["tp", "fp", "tn", "fn"]


def confusion(df: DataFrame, by: list[str], truth: str = "true_status", pred: str = "pred_status") -> DataFrame:
    """Counts over rows whose truth and prediction are both 0 or 1."""
    t, p = F.col(truth), F.col(pred)
    valid = df.filter(t.isin(0, 1) & p.isin(0, 1))
    return valid.groupBy(*by).agg(
        F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 1) & (p == 0)).alias("fn"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, f05, fpr, fnr; a zero denominator gives 0."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    out = counts.withColumns({"precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn)})
    return out.withColumns({
        "f1": f_beta(F.col("precision"), F.col("recall"), 1.0), "f05": f_beta(F.col("precision"), F.col("recall")),
        "fpr": safe_div(fp, fp + tn), "fnr": safe_div(fn, tp + fn)})


def sum_rounds(counts: DataFrame, by: list[str], required_rounds: int | None = None) -> DataFrame:
    """Micro-average: counts summed over rounds, then rates; groups missing a round drop out if asked."""
    summed = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS], F.countDistinct("round").alias("_rounds"))
    if required_rounds is not None:
        summed = summed.filter(F.col("_rounds") == required_rounds)
    return with_rates(summed.drop("_rounds"))


def ttf_metrics(tp_rows: DataFrame, by: list[str], truth: str = "ttf_true", bucket: str = "ttf_bucket_pred") -> DataFrame:
    """Macro-F1 over buckets, bucketed MAE and share within 5 days, over true positives with valid buckets."""
    usable = tp_rows.withColumns({"_p": F.trim(bucket), "_t": ttf_bucket(F.col(truth))}).filter(
        F.col("_p").isin(TTF_BUCKETS) & F.col("_t").isin(TTF_BUCKETS))
    err = F.abs(F.col(truth) - bucket_midpoint(F.col("_p")))
    aggs = [F.count("*").alias("n"), F.avg(err).alias("bmae"), F.avg(F.when(err <= 5.0, 1.0).otherwise(0.0)).alias("cov_pm5")]
    for i, b in enumerate(TTF_BUCKETS):
        t, p = F.col("_t") == b, F.col("_p") == b
        aggs += [F.count_if(t & p).alias(f"tp{i}"), F.count_if(~t & p).alias(f"fp{i}"), F.count_if(t & ~p).alias(f"fn{i}")]
    rows = usable.groupBy(*by).agg(*aggs)
    scores = []
    for i in range(len(TTF_BUCKETS)):
        tp, fp, fn = (F.col(f"{c}{i}") for c in ("tp", "fp", "fn"))
        scores.append(F.when(tp + fn > 0, f_beta(safe_div(tp, tp + fp), safe_div(tp, tp + fn), 1.0)))
    present = F.filter(F.array(*scores), lambda s: s.isNotNull())
    macro = F.aggregate(present, F.lit(0.0), lambda a, s: a + s) / F.size(present)
    return rows.select(*by, "n", macro.alias("macro_f1"), "bmae", "cov_pm5")


def ttf_error(df: DataFrame, by: list[str], truth: str = "true_ttf_days", pred: str = "pred_ttf_days") -> DataFrame:
    """Mean squared and absolute error of predicted days over rows that have both."""
    d = F.col(pred) - F.col(truth)
    return df.filter(d.isNotNull()).groupBy(*by).agg(
        F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.count("*").alias("n_examples"))


def grid_scores(df: DataFrame, by: list[str], score: str, label: str, grid: list[float] = THRESHOLD_GRID) -> DataFrame:
    """Precision, recall and F1 of ``score >= thr`` for every grid point.

    Rows are counted once per (group, number of grid points reached); the counts of a grid point are
    the totals of the cells at or above it, so the grid never multiplies the rows.
    """
    points = F.array(*[F.lit(float(t)) for t in grid])
    cell = let(F.col(score), lambda s: F.size(F.filter(points, lambda t: t <= s)))
    cells = df.groupBy(*by, cell.alias("cell")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    packed = cells.groupBy(*by).agg(F.collect_list(F.struct("cell", "pos", "neg")).alias("cells"))

    def total(field: str, i: Column | None = None) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(
            F.lit(True) if i is None else c["cell"] >= i, c[field]).otherwise(F.lit(0)))

    at = packed.select("*", F.posexplode(points).alias("i", "thr"))
    idx = F.col("i") + 1
    counts = at.select(*by, "thr", total("pos", idx).alias("tp"), total("neg", idx).alias("fp"),
                       total("pos").alias("_p"), total("neg").alias("_n"))
    full = counts.withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")}).drop("_p", "_n")
    return with_rates(full)


def best_f1(scores: DataFrame, by: list[str]) -> DataFrame:
    """Grid point with the highest F1, the lowest threshold among equals."""
    return _pick(scores, by, F.struct(F.col("f1"), -F.col("thr")))


def best_precision(scores: DataFrame, by: list[str]) -> DataFrame:
    """Highest precision among points with recall, else the best F1; lowest threshold among equals."""
    found = (F.col("recall") > 0).cast("int")
    return _pick(scores, by, F.struct(found, F.when(found == 1, F.col("precision")).otherwise(F.col("f1")), -F.col("thr")))


def _pick(scores: DataFrame, by: list[str], order: Column) -> DataFrame:
    best = scores.groupBy(*by).agg(F.max_by(F.struct("thr", "precision", "recall", "f1"), order).alias("b"))
    return best.select(*by, "b.*")


def curve_threshold(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Distinct score with the highest F1 of ``score >= thr``; the median score when no row is failed."""
    per_score = materialize(df.groupBy(*by, F.col(score).alias("thr")).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")), "scores")
    cums = running_totals(per_score, by, "thr", ["pos", "neg"], descending=True)
    totals = materialize(per_score.groupBy(*by).agg(F.sum("pos").alias("p_total")), "score-totals")
    scored = cums.join(totals, by).select(
        *by, "thr", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), (F.col("p_total") - F.col("cum_pos")).alias("fn"))
    rated = scored.withColumns({
        "precision": safe_div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_div(F.col("tp"), F.col("tp") + F.col("fn"))})
    rated = rated.withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1.0))
    best = _pick(rated.filter("precision + recall > 0"), by, F.struct(F.col("f1"), -F.col("thr")))
    median = exact_quantiles(per_score, by, "thr", [0.5], "n").select(*by, F.col("quantile").alias("median"))
    return median.join(best, by, "left").select(
        *by, F.coalesce("thr", "median").alias("thr"), F.coalesce("f1", F.lit(0.0)).alias("f1"))


def class_report(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted means."""
    c = with_rates(confusion(df, by, truth, pred))
    tp, fp, tn, fn = (F.col(x) for x in COUNTS)

    def cls(name: str, hit: Column, false: Column, miss: Column) -> Column:
        p, r = safe_div(hit, hit + false), safe_div(hit, hit + miss)
        return F.struct(F.lit(name).alias("cls"), p.alias("precision"), r.alias("recall"),
                        f_beta(p, r, 1.0).alias("f1"), (hit + miss).alias("support"))

    two = c.select(*by, F.array(cls("0", tn, fn, fp), cls("1", tp, fp, fn)).alias("c"))

    def mixed(name: str, weight) -> Column:
        n = F.col("c")[0]["support"] + F.col("c")[1]["support"]
        parts = [(weight(F.col("c")[i], n) * 1.0) for i in (0, 1)]
        return F.struct(F.lit(name).alias("cls"), *[
            (parts[0] * F.col("c")[0][m] + parts[1] * F.col("c")[1][m]).alias(m) for m in ("precision", "recall", "f1")],
            n.alias("support"))

    rows = two.select(*by, F.explode(F.concat("c", F.array(
        mixed("macro", lambda s, n: F.lit(0.5)), mixed("weighted", lambda s, n: safe_div(s["support"], n))))).alias("r"))
    return rows.select(*by, "r.*")


def apply_threshold(df: DataFrame, thresholds: DataFrame, by: list[str], score: str, out: str = "pred_status") -> DataFrame:
    """``score >= thr`` with one threshold row per group."""
    joined = df.join(F.broadcast(thresholds.select(*by, "thr")), by)
    return joined.withColumn(out, (F.col(score) >= F.col("thr")).cast("int")).drop("thr")
