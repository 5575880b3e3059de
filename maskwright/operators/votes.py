"""Votes: the option that a page's samples score highest together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def winner(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, option, total): of ``scores(*keys, option, place, score)`` the option with the highest sum of scores.

    Of equal sums the option that comes first wins, by the least of its places, then by its name. Null scores add nothing; a
    page whose options are all null has no row. Sums are taken per option before they are compared, so a page with many
    samples is summed where they lie and one row an option is shuffled.
    """
    sums = scores.where("option is not null").groupBy(*keys, "option").agg(F.coalesce(F.sum("score"), F.lit(0)).alias("total"), F.min("place").alias("place"))
    # A least struct: the highest sum, then the first place, then the name.
    best = F.min(F.struct((-F.col("total")).alias("lost"), "place", "option", "total")).alias("m")
    return sums.groupBy(*keys).agg(best).select(*keys, "m.option", "m.total")
