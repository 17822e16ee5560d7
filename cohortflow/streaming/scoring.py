"""Scoring of arriving rows with a frozen model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.frozen import score_frozen


def score_stream(rows: DataFrame, parameters: DataFrame, ids: list[str]) -> DataFrame:
    """Probabilities of a stream; the model is a plain column expression, so no state is kept."""
    return score_frozen(rows, parameters, ids)
