"""Integer confusion counts behind a published (precision, recall, F0.5) row.

For each tp the fp values that round back to the published precision and F0.5 form one interval,
because both fall as fp grows. So only tp is enumerated, and only where recall can round right; the
interval's ends give the candidate count and the FPR span, and the best fp of an interval is among a
handful of points. Nothing is capped and the work grows with 1 % of the failed support.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.fixed_values import SOURCE_RECONSTRUCTED, SOURCE_TARGETS, SOURCE_ZERO_ROW, ZERO_ROW_FPR
from fleetpulse.functions.scalars import f_beta, round_half_up, safe_div


def _measures(tp: Column, fp: Column, pos: Column) -> tuple[Column, Column, Column]:
    p, r = safe_div(tp, tp + fp), safe_div(tp, pos)
    return p, r, f_beta(p, r)


def _matches(tp: Column, fp: Column) -> Column:
    p, r, f = _measures(tp, fp, F.col("pos"))
    return ((round_half_up(p) == F.col("p")) & (round_half_up(r) == F.col("r")) & (round_half_up(f) == F.col("f")))


def tp_values(rows: DataFrame) -> DataFrame:
    """Rows (keys, p, r, f, pos, neg) times the tp whose recall rounds to r, or the nearest guess."""
    pos, r = F.col("pos"), F.col("r")
    lo = F.greatest(F.lit(0), F.floor((r - 0.006) * pos).cast("long"))
    hi = F.least(pos, F.ceil((r + 0.006) * pos).cast("long"))
    near = F.filter(F.sequence(lo, F.greatest(lo, hi)), lambda t: round_half_up(safe_div(t, pos)) == r)
    guess = F.array(F.greatest(F.lit(0), F.least(pos, F.bround(r * pos, 0).cast("long"))).cast("long"))
    return rows.withColumn("tp", F.explode(F.when(F.size(near) > 0, near).otherwise(guess)))


def fp_interval(rows: DataFrame) -> DataFrame:
    """Adds ``lo`` and ``hi``, the first and last fp that round back to the row; null without any."""
    tp, neg, p, f = F.col("tp"), F.col("neg"), F.col("p"), F.col("f")
    # P = tp/(tp+fp); F0.5 = 1.25 tp / (tp + fp + 0.25 pos): solve each rounding band for fp
    def solve(target: Column, shift: Column, scale: float) -> Column:
        return F.when(target > 0, scale * tp / target - shift)

    top_p, low_p = F.least(F.lit(1.0), p + 0.005), p - 0.005
    top_f, low_f = F.least(F.lit(1.0), f + 0.005), f - 0.005
    shift_f = tp + 0.25 * F.col("pos")
    start = F.greatest(F.lit(0.0), F.coalesce(solve(top_p, tp, 1.0), F.lit(0.0)), F.coalesce(solve(top_f, shift_f, 1.25), F.lit(0.0)))
    end = F.least(neg.cast("double"), F.coalesce(solve(low_p, tp, 1.0), neg.cast("double")),
                  F.coalesce(solve(low_f, shift_f, 1.25), neg.cast("double")))
    # the ends are real numbers; the exact rounding test settles the integers next to them
    around = lambda x, way: F.filter(F.transform(F.array(*[F.lit(i) for i in way]), lambda i: (F.floor(x) + i).cast("long")),
                                     lambda v: (v >= 0) & (v <= neg) & (v <= last) & _matches(tp, v))
    steps = [-2, -1, 0, 1, 2]
    # a precision exactly on the lower edge of its band is not searched
    last = F.when(low_p > 0, F.greatest(F.lit(0), F.floor(tp / low_p - tp - 1e-12).cast("long"))).otherwise(neg)
    end = F.least(end, last.cast("double"))
    # precision 0 is reached only by tp = 0, and there only fp = 0 is a candidate
    zero = F.col("p") == 0.0
    only = F.when((tp == 0) & _matches(tp, F.lit(0).cast("long")), F.lit(0).cast("long"))
    return rows.withColumns({
        "lo": F.when(zero, only).otherwise(F.array_min(around(start, steps))),
        "hi": F.when(zero, only).otherwise(F.array_max(around(end, steps)))})


def best_fp(rows: DataFrame) -> DataFrame:
    """Adds ``fp`` and ``err``: the fp of [lo, hi] with the smallest (error, fp).

    The error is |P - p| + |F - f|. Outside the two roots it is monotone and between them it has one
    stationary point, so its minimum is at an end, next to a root or next to that point.
    """
    tp, pos = F.col("tp"), F.col("pos")
    root_p = F.when(F.col("p") > 0, tp / F.col("p") - tp)
    root_f = F.when(F.col("f") > 0, 1.25 * tp / F.col("f") - tp - 0.25 * pos)
    # P' = F' where (fp + tp) * sqrt(1.25) = fp + tp + 0.25 pos
    flat = 0.25 * pos / (F.lit(1.25) ** 0.5 - 1.0) - tp
    points = []
    for x in (root_p, root_f, flat):
        points += [F.floor(x).cast("long"), F.ceil(x).cast("long")]
    spots = F.array(F.col("lo"), F.col("hi"), *[F.greatest(F.col("lo"), F.least(F.col("hi"), c)) for c in points])

    def scored(v: Column) -> Column:
        p, r, f = _measures(tp, v, pos)
        err = F.abs(p - F.col("p")) + F.abs(r - F.col("r")) + F.abs(f - F.col("f"))
        return F.struct(err.alias("err"), v.alias("fp"))

    best = F.array_min(F.transform(F.filter(spots, lambda v: v.isNotNull()), scored))
    return rows.withColumn("_b", F.when(F.col("lo").isNotNull(), best)).select("*", "_b.err", "_b.fp").drop("_b")


def reconstruct(rows: DataFrame, keys: list[str], zero_row_fpr: float | None = ZERO_ROW_FPR) -> DataFrame:
    """Best confusion counts, candidate count, FPR span and source per published row.

    Rows that are all zero use ``max(1, round(neg * zero_row_fpr))`` false positives, or 0 when it is
    None. Rows without any candidate fall back to the published targets.
    """
    given = rows.select(*keys, *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("p", "r", "f")],
                        F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"))
    neg, pos = F.col("neg"), F.col("pos")
    tried = best_fp(fp_interval(tp_values(given)))
    all_zero = (F.col("p") == 0) & (F.col("r") == 0) & (F.col("f") == 0)
    visible = (F.lit(0) if zero_row_fpr is None else F.least(neg, F.greatest(
        F.lit(1), F.bround(neg * F.lit(zero_row_fpr), 0).cast("long")))).cast("long")
    if zero_row_fpr is None:
        ok = all_zero & (round_half_up(safe_div(F.col("tp"), pos)) == 0) & (F.col("tp") == 0)
    else:
        ok = all_zero
    # an all-zero row scores the error of precision 0, its recall and F0.5 0
    zero_err = F.when(F.lit(zero_row_fpr is None), F.lit(0.0)).otherwise(safe_div(F.col("tp"), pos))
    tried = tried.withColumns({
        "lo": F.when(ok, visible).when(~all_zero, F.col("lo")),
        "hi": F.when(ok, visible).when(~all_zero, F.col("hi")),
        "fp": F.when(ok, visible).when(~all_zero, F.col("fp")),
        "err": F.when(ok, zero_err).when(~all_zero, F.col("err"))})
    found = tried.filter(F.col("fp").isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct("tp", "fp"), F.struct("err", F.col("tp") + F.col("fp"), "fp")).alias("b"),
        F.sum(F.col("hi") - F.col("lo") + 1).alias("n"), F.min("lo").alias("fp_min"), F.max("hi").alias("fp_max"))
    joined = given.join(found, keys, "left")
    none = F.col("b").isNull()
    tp0 = F.greatest(F.lit(0), F.least(pos, F.bround(F.col("r") * pos, 0).cast("long")))
    fp0 = F.when(F.col("p") <= 0, F.greatest(F.lit(1), F.bround(neg * F.lit(zero_row_fpr), 0).cast("long"))
                 if zero_row_fpr is not None else F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.least(neg, F.bround(tp0 * (F.lit(1.0) / F.col("p") - 1.0), 0).cast("long"))))
    out = joined.select(
        *keys, "p", "r", "f", "pos", "neg",
        F.when(none, tp0).otherwise(F.col("b.tp")).alias("tp"), F.when(none, fp0).otherwise(F.col("b.fp")).alias("fp"),
        F.coalesce("n", F.lit(0)).alias("candidate_count"), "fp_min", "fp_max",
        F.when(none, SOURCE_TARGETS).when(all_zero, SOURCE_ZERO_ROW).otherwise(SOURCE_RECONSTRUCTED).alias("source"))
    out = out.withColumns({"fn": pos - F.col("tp"), "tn": neg - F.col("fp")})
    p, r, f = _measures(F.col("tp"), F.col("fp"), pos)
    # an all-zero row keeps precision 0 and F0.5 0 whatever its tp
    zero = F.col("source") == SOURCE_ZERO_ROW
    return out.withColumns({
        "precision": F.when(zero, F.lit(0.0)).otherwise(p), "recall": r, "f05": F.when(zero, F.lit(0.0)).otherwise(f),
        "fpr": safe_div(F.col("fp"), neg), "fnr": safe_div(F.col("fn"), pos),
        "fpr_lower": safe_div(F.coalesce("fp_min", "fp"), neg), "fpr_upper": safe_div(F.coalesce("fp_max", "fp"), neg),
    }).withColumn("fpr_span", F.col("fpr_upper") - F.col("fpr_lower")).drop("fp_min", "fp_max")


def prefer_predictions(measured: DataFrame, rebuilt: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Counts from predictions where every round has them, else the reconstructed ones."""
    have = measured.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("tp", "fp", "tn", "fn")])
    joined = rebuilt.join(have, keys, "left")
    found = F.col("_tp").isNotNull()
    out = joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("tp", "fp", "tn", "fn")})
    out = out.withColumns({"source": F.when(found, source).otherwise(F.col("source")),
                           "candidate_count": F.when(~found, F.col("candidate_count"))})
    p, r, f = _measures(F.col("tp"), F.col("fp"), F.col("tp") + F.col("fn"))
    out = out.withColumns({"precision": F.when(found, p).otherwise(F.col("precision")), "recall": r,
                           "f05": F.when(found, f).otherwise(F.col("f05"))})
    return out.withColumns({"fpr": safe_div(F.col("fp"), F.col("fp") + F.col("tn")),
                            "fnr": safe_div(F.col("fn"), F.col("tp") + F.col("fn"))}).drop("_tp", "_fp", "_tn", "_fn")


def ambiguity_summary(detail: DataFrame) -> DataFrame:
    """Row count, rows with several candidates, the widest FPR span and the row that has it."""
    many = F.col("candidate_count") > 1
    worst = F.when(many, F.struct("fpr_span", "method", "backbone", "dataset"))
    return detail.agg(
        F.count("*").alias("row_count"), F.count_if(many).alias("ambiguous_row_count"),
        F.coalesce(F.max(F.when(many, F.col("fpr_span"))), F.lit(0.0)).alias("max_fpr_span"),
        F.max(worst).alias("w"),
    ).select("row_count", "ambiguous_row_count", "max_fpr_span", F.col("w.method").alias("worst_method"),
             F.col("w.backbone").alias("worst_backbone"), F.col("w.dataset").alias("worst_dataset"))


def audit(detail: DataFrame) -> DataFrame:
    """Largest deviation of FNR from 1 - recall and of FPR from its counts."""
    return detail.agg(
        F.max(F.abs(F.col("fnr") - (1.0 - F.col("recall")))).alias("fnr_diff"),
        F.max(F.abs(F.col("fpr") - safe_div(F.col("fp"), F.col("fp") + F.col("tn")))).alias("fpr_diff"))
