"""Free-text answers to prediction fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.fixed_values import ATTRIBUTE_WORDS
from fleetpulse.functions.scalars import let, status_flag

ANSWER = ("struct<status:string, concern_level:string, ttf_days:string, ttf_bucket:string, explanation:string, "
          "recommendations:string>")


def json_block(text: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; null when there is none."""
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(block != "", block)


def status_from_free_text(text: Column) -> Column:
    """Status phrase in the last five lines: at-risk phrases first, then healthy ones, else null."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")

    def tail(lines: Column) -> Column:
        return F.lower(F.array_join(F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), 5), "\n"))

    def rules(t: Column) -> Column:
        risk = t.contains("drive is at_risk") | t.contains("drive is at risk") | t.contains(
            "status is at_risk") | t.contains("status is at risk")
        return F.when(risk, "AT_RISK").when(t.contains("drive is healthy") | t.contains("status is healthy"), "HEALTHY")

    return let(tail(F.split(stripped, r"\r\n|\r|\n")), rules)


def ttf_number(value: Column) -> Column:
    """Whole days from a number or numeric text, cut towards zero; null otherwise."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), text.cast("double")).cast("int")


def join_recommendations(items: Column) -> Column:
    return F.array_join(items, " || ")


def parse_answers(df: DataFrame, raw: str = "raw_text", words: str = "risk") -> DataFrame:
    """Raw answer to prediction fields; an unreadable answer sets ``parse_error`` and keeps the row."""
    # bad JSON has to give null, as get_json_object does, so that the row is flagged
    block = json_block(F.col(raw))

    def field(name: str, default: str) -> Column:
        return F.coalesce(F.get_json_object("_block", f"$.{name}"), F.lit(default))

    staged = df.withColumn("_block", block).withColumn(
        "parse_error", F.when(F.col("_block").isNull(), "no JSON object")
        .when(F.get_json_object("_block", "$").isNull(), "bad JSON"))
    items = F.get_json_object("_block", "$.recommendations")
    good = F.col("parse_error").isNull()
    return staged.select(
        *df.columns, "parse_error",
        F.when(good, field("status", "HEALTHY")).alias("status_text"),
        F.when(good, field("concern_level", "LOW concern")).alias("concern_level"),
        F.when(good, ttf_number(F.get_json_object("_block", "$.ttf_days"))).alias("pred_ttf_days"),
        F.when(good, field("ttf_bucket", "NONE")).alias("pred_ttf_bucket"),
        F.when(good, field("explanation", "")).alias("explanation"),
        F.when(good, F.when(items.startswith("["), F.from_json(items, "array<string>"))
               .when(items.isNull(), F.array().cast("array<string>")).otherwise(F.array(items))).alias("recommendations"),
        F.when(good, status_flag(field("status", "HEALTHY"), words)).alias("pred_status"),
    )


def attr_mentioned(text: Column, attr: Column, words: dict[str, list[str]] = ATTRIBUTE_WORDS) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for name, terms in words.items():
        hit = F.lit(False)
        for term in terms:
            hit = hit | low.contains(term.lower())
        out = F.when(attr == name, hit).otherwise(out)
    return out


def ensure_mentions(text: Column, summary: Column, attrs: list[str],
                    words: dict[str, list[str]] = ATTRIBUTE_WORDS) -> Column:
    """Appends a clause naming the attributes the text does not mention, with their summary line."""
    pieces = []
    for attr in attrs:
        line = F.trim(F.regexp_extract(summary, attr + r":[^\n]*", 0))
        named = F.when(line != "", line).otherwise(F.lit(attr))
        pieces.append(F.when(~attr_mentioned(text, F.lit(attr), words), named))
    missing = F.filter(F.array(*pieces), lambda p: p.isNotNull())
    clause = F.concat(F.lit(" Key SMART attributes involved: "), F.array_join(missing, "; "), F.lit("."))
    right = F.regexp_replace(text, r"\s+$", "")
    return (
        F.when(F.size(missing) == 0, text)
        .when(right.endswith("."), F.concat(text, clause))
        .otherwise(F.concat(right, F.lit(". "), clause))
    )
