"""Quality rules: text statistics as column expressions, and a decision list learned by sequential covering.

A rule is a conjunction of thresholds on statistics, such as ``symbol_share >= 0.02 AND mean_word <= 9.1``. It grows on
two thirds of the labelled rows by the condition of the largest information gain, is pruned on the last third, joins
the list if it is precise there, and the rows it covers are set aside for the next rule either way. All counts are Spark aggregates over
rows binned at quantiles, so learning brings a few numbers a step to the driver, however many rows are labelled. The list is
emitted as one ordered conditional expression.

Words are runs without the blanks U+0020 and U+0009 to U+000D. Null texts count as empty: all statistics are 0. Rows that
fail the base rules aren't kept. Labels that are null are left out; a document that is labelled twice counts twice in
learning and once in the result; without labels, or without junk among them, the list is empty and everything that
passes the base rules is kept. Repeated rows and empty tables need nothing special. Texts are read whole. Other input
columns pass through, but for those named like an output column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.scalars import let
from fleetpulse.llm.common import free_name, materialize

BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_share", "caps_share", "bang_share", "dup_line_share", "repeat_share")
ADDED = (*BASE, *FEATURES[1:], "base_failed")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the text.

    Windows are compared by a 64-bit hash. Texts without a repeated window (most) stop at the comparison of two sizes.
    """

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda n, x: n + x,
        )

    def repeats(ordered: Column) -> Column:
        def at(x: Column, k: Column) -> Column:
            same = (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"])
            return F.when(same, x["at"])

        return let(F.sort_array(F.filter(F.transform(ordered, at), lambda p: p.isNotNull())), covered)

    def count(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, repeats))

    def hashed(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda k: F.xxhash64(F.slice(hashes, k, WINDOW)))
        return let(windows, count)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), hashed))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row without its text, with the statistics and ``base_failed``."""
    keep = [c for c in docs.columns if c != text_col and c not in ADDED]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)).alias("word_chars"),
            repeated_words(words).cast("bigint").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("dup"))

    def count(pattern: str) -> Column:
        return (F.length("__text") - F.length(F.regexp_replace("__text", pattern, ""))).cast("bigint")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), text.alias("__text"))
    rows = rows.select(
        "__row",
        let(F.array_remove(F.split("__text", BLANKS), ""), of_words).alias("w"),
        let(F.filter(F.split("__text", "\n"), lambda x: x.rlike(NOT_BLANK)), of_lines).alias("l"),
        count(SYMBOLS).alias("n_symbols"),
        count(r"\p{Lu}").alias("caps"),
        count("!").alias("bangs"),
    )

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    n, chars = F.col("w.n_words"), F.col("w.word_chars")
    return rows.select(
        *[F.col("__row")[c].alias(c) for c in keep],
        n.alias("n_words"), chars.alias("word_chars"), "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.n_repeat_words").alias("n_repeat_words"),
        share(chars, n).alias("mean_word"), share(F.col("n_symbols"), chars).alias("symbol_share"), share(F.col("caps"), chars).alias("caps_share"),
        share(F.col("bangs"), chars).alias("bang_share"), share(F.col("l.dup"), F.col("l.n")).alias("dup_line_share"),
        share(F.col("w.n_repeat_words"), n).alias("repeat_share"),
        ((n < 20) | (100 * F.col("w.n_repeat_words") > 30 * n)).alias("base_failed"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float
    bin: int  # rows fulfil it whose bin is at least (above) or less than this

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value!r}D"

    def of_bins(self) -> Column:
        return F.col(f"bin_{self.feature}") >= self.bin if self.above else F.col(f"bin_{self.feature}") < self.bin


@dataclass
class DecisionList:
    """Ordered rules for junk; what no rule covers is kept."""

    rules: list[list[Condition]] = field(default_factory=list)
    precision: list[float] = field(default_factory=list)

    def kept(self) -> Column:
        out = None
        for rule in self.rules:
            hit = F.expr(" AND ".join(map(str, rule)))
            out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(f"IF {' AND '.join(map(str, r))} THEN junk ({p:.3f})" for r, p in zip(self.rules, self.precision)) + "\nELSE keep"


def bin_of(feature: str, cuts: list[float]) -> Column:
    """How many cuts the feature has reached."""
    value = F.col(feature).cast("double")
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]).cast("array<double>"), lambda x: x <= value))


def both(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.of_bins()
    return out


def learn_decision_list(
    labelled: DataFrame, junk: str = "junk", key: str = "doc_id", features: tuple[str, ...] = FEATURES,
    bins: int = 64, max_rules: int = 10, max_conditions: int = 4, least_precision: float = 0.9, least_rows: int = 3,
) -> DecisionList:
    """``labelled`` has the features, a boolean ``junk`` and a key that deals its rows to growing and pruning."""
    labelled = labelled.filter(F.col(junk).isNotNull())
    quantiles = [k / bins for k in range(1, bins)] + [0.995, 0.999]
    found = labelled.agg(*[F.percentile_approx(f, quantiles, 1000).alias(f) for f in features]).first()
    cuts = {f: sorted({float(x) for x in found[f] or []}) for f in features}
    binned = [bin_of(f, cuts[f]).alias(f"bin_{f}") for f in features]
    fold = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(3)) == 0
    cells = labelled.select(*binned, F.col(junk).alias("junk"), fold.alias("prune"))
    cells = materialize(cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("n")), "quality-cells")

    out, left = DecisionList(), cells
    for _ in range(max_rules):
        rule: list[Condition] = []
        grown: list[tuple[int, int]] = []
        while len(rule) < max_conditions:
            inside = left.filter(~F.col("prune") & both(rule))
            each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in features])).alias("x")
            junk_n, fine_n = F.sum(F.when(F.col("junk"), F.col("n")).otherwise(0)), F.sum(F.when(~F.col("junk"), F.col("n")).otherwise(0))
            table = inside.select(each, "junk", "n").groupBy("x.f", "x.b").agg(junk_n.alias("p"), fine_n.alias("q")).collect()
            best = best_condition(table, cuts)
            if best is None:
                break
            rule.append(best[1])  # a later threshold on the same side of a feature is the tighter one
            grown.append(best[2])
            if best[2][1] == 0:
                break
        if not rule:
            break
        checks = [(F.sum(F.when(both(rule[:k]) & F.col("junk"), F.col("n"))), F.sum(F.when(both(rule[:k]) & ~F.col("junk"), F.col("n")))) for k in range(1, len(rule) + 1)]
        counts = left.filter("prune").agg(*[c.alias(f"c{k}") for k, c in enumerate(x for pair in checks for x in pair)]).first()
        scores = [(counts[2 * k] or 0, counts[2 * k + 1] or 0) for k in range(len(rule))]
        worth = [(p - q) / (p + q) if p + q else -1.0 for p, q in scores]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, q = scores[k]
        if p >= least_rows and p >= least_precision * (p + q):
            out.rules.append(rule[: k + 1])
            out.precision.append(p / (p + q))
        left = left.filter(~both(rule[: k + 1]))
    return out


def best_condition(table: list, cuts: dict[str, list[float]]) -> tuple[float, Condition, tuple[int, int]] | None:
    """The threshold of the largest gain in information about junk, from counts of junk (p) and other rows (q) by bin."""
    best = None
    for f, values in cuts.items():
        own = {r["b"]: (r["p"], r["q"]) for r in table if r["f"] == f}
        p_all, q_all = sum(p for p, _ in own.values()), sum(q for _, q in own.values())
        if not p_all or not q_all:
            continue
        prior, below = math.log2(p_all / (p_all + q_all)), [0, 0]
        for b in range(1, len(values) + 1):
            below = [x + y for x, y in zip(below, own.get(b - 1, (0, 0)))]
            for above, (p, q) in ((False, below), (True, [p_all - below[0], q_all - below[1]])):
                if p and p + q < p_all + q_all:
                    gain = p * (math.log2(p / (p + q)) - prior)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Condition(f, above, values[b - 1], b), (p, q))
    return best


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", quality: str = "quality", **settings) -> tuple[DataFrame, DecisionList]:
    """All rows with statistics, ``base_failed`` and ``kept``, and the list learned from ``labels`` (0 is junk)."""
    rows = materialize(text_statistics(docs, text_col), "quality-statistics")
    mark, junk = free_name(rows.columns, "__key"), free_name(rows.columns, "__junk")
    marks = labels.select(F.col(f"`{key}`").alias(mark), (F.col(f"`{quality}`") == 0).alias(junk))
    labelled = rows.join(marks, F.col(f"`{key}`") == F.col(mark)).select(*FEATURES, F.col(junk).alias("junk"), F.col(mark).alias("key"))
    learned = learn_decision_list(labelled, key="key", **settings)
    return rows.withColumn("kept", ~F.col("base_failed") & learned.kept()), learned
