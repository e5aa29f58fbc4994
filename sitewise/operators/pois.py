"""Points of interest: from response elements to a facility table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions import not_in


def flatten(elements: DataFrame) -> DataFrame:
    """A facility of each element: nodes have a place of their own, others their centre's; those without either go."""
    node = F.col("type") == "node"
    lon, lat = F.when(node, F.col("lon")).otherwise(F.col("center.lon")), F.when(node, F.col("lat")).otherwise(F.col("center.lat"))
    return elements.where(node | F.col("center").isNotNull()).select(
        F.col("id").alias("osm_id"), F.col("type").alias("osm_type"), *[F.col("tags")[k].alias(k) for k in ("name", "amenity", "healthcare")],
        lon.alias("lon"), lat.alias("lat"),
    )


def exclude_tag(pois: DataFrame, values: Sequence[str] | None, *, column: str = "healthcare") -> DataFrame:
    """Drops the listed values; rows without a value stay."""
    return pois.where(not_in(F.col(column), list(values))) if values else pois


def exclude_name(pois: DataFrame, keywords: Sequence[str] | None, *, column: str = "name") -> DataFrame:
    """Drops names in which one of the keywords, each a pattern, is found, whatever their case; rows without a name stay."""
    if not keywords:
        return pois
    return pois.where(~F.lower(F.coalesce(F.col(column), F.lit(""))).rlike("|".join(keywords)))


def distinct_elements(*parts: DataFrame) -> DataFrame:
    """The union of several responses, each element once."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.dropDuplicates(["type", "id"])
