"""Scores of need and demand on scales from 0 to 1, and the better kind of facility for each cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.functions import not_in, null_for_nan

#: Kinds of area that get no facility.
EXCLUDED_AREAS = ("industrial",)


def normalize(df: DataFrame, **scales: Column | str) -> DataFrame:
    """Adds each named expression, scaled by its least and largest value over all rows.

    Where these are equal every row gets 0, null ones too; otherwise nulls stay
    null. The bounds are one scalar subquery for all scales: a partial
    aggregate and no window over the whole table.
    """
    values = {k: null_for_nan((F.col(v) if isinstance(v, str) else v).cast("double")) for k, v in scales.items()}
    bounds = df.agg(F.struct(*[f(v).alias(f"{k}_{n}") for k, v in values.items() for n, f in (("lo", F.min), ("hi", F.max))]).alias("b")).scalar()
    scaled = {k: F.when(bounds[f"{k}_lo"] == bounds[f"{k}_hi"], F.lit(0.0)).otherwise((v - bounds[f"{k}_lo"]) / (bounds[f"{k}_hi"] - bounds[f"{k}_lo"])) for k, v in values.items()}
    return df.withColumns(scaled)


def with_scores(cells: DataFrame) -> DataFrame:
    """Adds ``equity`` (people and few facilities) and ``profit`` (people, wealth and few facilities)."""
    parts = normalize(cells, _pop="population", _wealth="wealth_score", _scarce=F.lit(1.0) / (F.lit(1.0) + F.col("existing_clinics")))
    both = normalize(parts, equity=F.col("_pop") * F.col("_scarce"), profit=F.col("_pop") * F.col("_wealth") * F.col("_scarce"))
    return both.drop("_pop", "_wealth", "_scarce")


def with_facility_type(scored: DataFrame, *, equity_weight: float = 1.0, profit_weight: float = 1.0) -> DataFrame:
    """Weighs the scores and adds ``facility_type`` and ``best_score``; equal scores are public, a cell without profit is private with its equity."""
    weighed = scored.withColumns({"equity": F.col("equity") * equity_weight, "profit": F.col("profit") * profit_weight})
    kind = F.when(F.col("equity") >= F.col("profit"), "public").otherwise("private")
    return weighed.withColumns({"facility_type": kind, "best_score": F.greatest("equity", "profit")})


def filter_candidates(cells: DataFrame) -> DataFrame:
    """Cells of an excluded kind of area go; those without a kind stay."""
    return cells.where(not_in(F.col("area_character"), EXCLUDED_AREAS))
