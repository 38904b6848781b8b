"""Scalar column functions: dates, buckets, status words, ratios."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from fleetpulse.fixed_values import GROUP_WORDS, LABEL_ROLES, TTF_MIDPOINTS


def let(value: Column, body) -> Column:
    """Bind a value once and use it several times: ``let(x, lambda v: v + v)``.

    Needed above all where a value is used inside a lambda: the optimizer counts that as one use, may
    inline the value there, and it would then be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(value, ddl: str) -> Column:
    """A small nested Python value as one literal: folded at planning time, however many numbers it holds."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def parse_day(ds: Column) -> Column:
    """``20180131`` (number or text) to DATE; anything unreadable becomes null."""
    text = F.trim(ds.cast("string"))
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))


def parse_failure_time(value: Column) -> Column:
    """Failure time as timestamp text, day text or a yyyymmdd number, cut to DATE."""
    text = F.trim(value.cast("string"))
    return F.coalesce(parse_day(text), F.when(~text.rlike("^[0-9]+$"), text.try_cast("timestamp_ntz")).cast("date"))


def days_to_failure(day: Column, failure_day: Column) -> Column:
    """Calendar days from the snapshot to the failure; null without one, negative after it."""
    return F.date_diff(failure_day.cast("date"), day.cast("date"))


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def ttf_bucket(ttf: Column) -> Column:
    days = ttf.try_cast("double")
    return (
        F.when(days.isNull() | F.isnan(days) | (days < 0), "NONE")
        .when(days < 7, "<7")
        .when(days <= 30, "7-30")
        .otherwise(">30")
    )


def bucket_midpoint(bucket: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, mid in TTF_MIDPOINTS.items():
        out = F.when(F.trim(bucket) == name, F.lit(mid)).otherwise(out)
    return out


def status_flag(status: Column, words: str = "risk") -> Column:
    """Status text to 0/1. ``words``: "risk", "risk_or_fail", or "judge" (also accepts 1)."""
    text = F.translate(F.upper(F.trim(status.cast("string"))), "-", "_")
    hit = text.contains("RISK")
    if words in ("risk_or_fail", "judge"):
        hit = hit | text.contains("FAIL")
    if words == "judge":
        hit = hit | (text == "1")
    return F.when(hit, 1).otherwise(0)


def normalize_bucket(bucket: Column) -> Column:
    text = F.trim(bucket)
    blank = bucket.isNull() | F.upper(text).isin("NONE", "NO_FAILURE", "NULL", "")
    return F.when(blank, "NO_FAILURE").otherwise(text)


def concern_rank(level: Column) -> Column:
    text = F.upper(F.coalesce(level, F.lit("")))
    high = text.contains("SERIOUS") | text.contains("HIGH") | text.contains("CRITICAL")
    return F.when(high, 2).when(text.contains("LOW"), 0).otherwise(1)


def normalize_backbone(name: Column) -> Column:
    text = F.trim(name)
    return F.when(name.isNull() | (text == "") | (F.lower(text) == "nan"), "-").otherwise(text)


def safe_name(name: Column) -> Column:
    return F.translate(name, "/ ", "__")


def feature_group(name: Column) -> Column:
    """Group of an attribute by the words in its name; "other" when none matches."""
    low = F.lower(name)
    out = F.lit("other")
    for group, words in reversed(list(GROUP_WORDS.items())):
        out = F.when(low.rlike("|".join(words)), group).otherwise(out)
    return out


def feature_group_of(name: str, groups: dict[str, str] | None = None) -> str:
    """The same for a name known on the driver, with an optional explicit mapping."""
    if groups and name in groups:
        return groups[name]
    low = name.lower()
    return next((g for g, words in GROUP_WORDS.items() if any(w in low for w in words)), "other")


def label_role(label: Column) -> Column:
    out = F.lit("noisy")
    for role, labels in LABEL_ROLES.items():
        out = F.when(label.isin(labels), role).otherwise(out)
    return out


def phrase_of(label: Column, phrases: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for pair in phrases.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(default))


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    b2 = beta * beta
    den = F.lit(b2) * precision + recall
    return F.when(den != 0, F.lit(1.0 + b2) * precision * recall / den).otherwise(F.lit(0.0))


def eps_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 with 1e-9 in every denominator, as threshold tuning wants it."""
    p = tp / (tp + fp + F.lit(1e-9))
    r = tp / (tp + fn + F.lit(1e-9))
    return F.lit(2.0) * p * r / (p + r + F.lit(1e-9))


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Half-up on the shortest decimal text of the number."""
    return F.round(value.cast("double"), digits)


def assumed_ratio_fpr(precision: Column, recall: Column, healthy_per_failed: float) -> Column:
    if healthy_per_failed <= 0:
        raise ValueError("healthy_per_failed must be positive")
    raw = recall * (F.lit(1.0) / precision - F.lit(1.0)) / F.lit(float(healthy_per_failed))
    return F.when((precision > 0) & (recall > 0), F.greatest(F.lit(0.0), raw)).otherwise(F.lit(0.0))


def finite_or_zero(value: Column) -> Column:
    v = value.cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def finite_or_null(value: Column) -> Column:
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)
