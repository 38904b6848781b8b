"""Predictions to the three result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetpulse.operators import metrics as M, reports as P
from fleetpulse.sources.evaluation_io import true_positive_details

RUN = ["method", "backbone", "dataset"]


def status_table(predictions: DataFrame, datasets: list[str], required_rounds: int, index: DataFrame | None = None,
                 grid: DataFrame | None = None) -> DataFrame:
    """Confusions summed over rounds, one row per method and backbone, wide by dataset.

    With ``index`` (dataset, round, test_index) only predictions in the sampled index count. A dataset of which a round is
    missing has null cells.
    """
    if index is not None:
        chosen = index.select(F.upper(F.trim("dataset")).alias("dataset"), "round", F.col("test_index").alias("index")).distinct()
        predictions = predictions.join(chosen, ["dataset", "round", "index"], "left_semi")
    summed = M.sum_rounds(M.confusion(predictions, [*RUN, "round"]), RUN, required_rounds)
    runs = predictions.select(*RUN).distinct().join(summed, RUN, "left")
    rows = runs if grid is None else P.on_grid(summed, grid)
    return P.to_wide(rows, ["method", "backbone"], datasets).orderBy("method", "backbone")


def ttf_table(predictions: DataFrame, by: tuple[str, ...] = ("backbone", "dataset")) -> DataFrame:
    """Time-to-failure metrics of the true positives per backbone and dataset; an index names a row only within its run."""
    return M.ttf_metrics(true_positive_details(predictions, by), list(by))


def explanation_table(judge_scores: DataFrame, variants: DataFrame) -> DataFrame:
    """Judge means and robustness shares per backbone; a backbone without either keeps its row."""
    return P.judge_means(judge_scores, ["backbone"]).join(P.robustness(variants, ["backbone"]), "backbone", "full")
