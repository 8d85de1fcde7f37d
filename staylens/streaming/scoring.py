"""Scoring searches as they arrive.

Scoring keeps no state: features come from the search's own row and hotels from a written table.
Only the removal of repeated searches needs memory, and a watermark bounds it.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from staylens.operators import forest_table, value
from staylens.operators.hotels import SUPPORT_COLUMNS
from staylens.operators.joins import broadcast_if_small
from staylens.operators.stays import SEARCH, search_features


def score_stream(
    searches: DataFrame,
    support: DataFrame,
    model: PipelineModel | forest_table.ForestSql,
    event_time: str,
    delay: str = "1 hour",
    out_of_range: str = "error",
) -> DataFrame:
    """Scores of a stream of searches; a search id seen again within ``delay`` is ignored."""
    once = searches.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["search_id"])
    known = broadcast_if_small(support.select(*SUPPORT_COLUMNS))
    matrix = value.score_matrix(search_features(once, dedupe=False), known)
    return forest_table.score_with(model, matrix, SEARCH, out_of_range)
