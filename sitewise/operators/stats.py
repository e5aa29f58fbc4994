"""Correlation, histograms and other figures of a report."""

from __future__ import annotations

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sitewise.durable import durable


def mid_ranks(df: DataFrame, column: str, name: str, *, partitions: int = 64) -> DataFrame:
    """Adds the rank of each value, ties sharing the mean of theirs; nulls have none.

    Values are counted first. Their counts are summed within ranges and the
    ranges' totals, a row each, in front: no task sees all rows.
    """
    value = F.col(column)
    counts = df.where(value.isNotNull()).groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = durable(counts.repartitionByRange(partitions, "_v").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.sum("_n").alias("_all")).select("_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranged.withColumn("_below", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(F.broadcast(offsets), "_part")
    ranks = durable(ranks.select(F.col("_v"), F.col("_n"), (F.col("_offset") + F.col("_below") + (F.col("_n") + 1) / 2).alias(name)))
    # Values with over a ten-thousandth of the rows are ten thousand at most: broadcast, so no task has all rows of one.
    bound = (ranks.agg(F.sum("_n")).first()[0] or 0) / 10_000
    often = F.broadcast(ranks.where(F.col("_n") > bound).drop("_n"))
    rare = df.join(often, df[column] == often["_v"], "left_anti").join(ranks.where(F.col("_n") <= bound).drop("_n"), df[column] == F.col("_v"), "left")
    return rare.unionByName(df.join(often, df[column] == often["_v"])).drop("_v")


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row, rho and n, over the rows where both are set; rho is null if either is constant or there are fewer than two rows."""
    both = pairs.na.drop(subset=[x, y]).select(x, y)
    ranked = mid_ranks(mid_ranks(both, x, "_x"), y, "_y")
    varied = (F.stddev_pop("_x") > 0) & (F.stddev_pop("_y") > 0)
    # Centred sums: the rank's mean is known, so one pass is exact enough.
    n = F.count(F.lit(1))
    got = ranked.agg(
        n.alias("n"), varied.alias("_ok"), F.sum(F.col("_x") * F.col("_y")).alias("xy"), F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_y") * F.col("_y")).alias("yy")
    )
    centre = F.col("n") * (F.col("n") + 1) * (F.col("n") + 1) / 4.0
    rho = F.try_divide(F.col("xy") - centre, F.sqrt(F.col("xx") - centre) * F.sqrt(F.col("yy") - centre))
    return got.select(F.when(F.col("_ok"), F.least(F.greatest(rho, F.lit(-1.0)), F.lit(1.0))).alias("rho"), F.col("n"))


@F.pandas_udf(T.DoubleType())
def p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom; null without a rho or below three rows."""
    import math

    def fraction(a: float, b: float, x: float) -> float:
        """The continued fraction of the incomplete beta function, by Lentz's way."""
        tiny = 1e-300
        c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
        value = d
        for m in range(1, 500):
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + term * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + term / c
                c = c if abs(c) > tiny else tiny
                value *= c * d
            if abs(c * d - 1.0) < 1e-15:
                break
        return value

    def beta(a: float, b: float, x: float) -> float:
        """The regularised incomplete beta function."""
        if x in (0.0, 1.0):
            return x
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * fraction(b, a, 1.0 - x) / b

    def one(r: float, k: float) -> float | None:
        if r is None or math.isnan(r) or k < 3:
            return None
        return 0.0 if abs(r) >= 1 else beta((k - 2) / 2, 0.5, 1.0 - r * r)

    return pd.Series([one(r, k) for r, k in zip(rho, n, strict=True)], dtype="float64")


def spearman_vs_price(cells: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: rho, p_value, n of wealth_score against price_per_m2. A cell with several prices counts for each."""
    joined = cells.select("cell_id", F.col("wealth_score").cast("double")).join(prices.select("cell_id", "price_per_m2"), "cell_id")
    return spearman(joined, "wealth_score", "price_per_m2").select("rho", p_value("rho", "n").alias("p_value"), "n")


def unit_histogram(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """bin, n: counts in steps of one from low to high, the last step closed; empty bins have 0, values outside don't count."""
    x = F.col(column)
    counted = df.where(x.between(low, high)).groupBy(F.least(F.floor(x), F.lit(high - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    bins = df.sparkSession.range(low, high).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"))


def equal_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (from 0), low, high, n: counts in equal steps over the data's range, the last step closed; a single value has steps around it."""
    x = F.col(column).cast("double")
    span = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("b")).scalar()
    single = span["lo"] == span["hi"]
    lo, hi = F.when(single, span["lo"] - 0.5).otherwise(span["lo"]), F.when(single, span["hi"] + 0.5).otherwise(span["hi"])
    at = F.least(F.width_bucket(x, lo, hi, F.lit(bins)), F.lit(bins)) - 1
    counted = df.where(x.isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    step = (hi - lo) / bins
    return every.join(counted, "bin", "left").select(
        "bin", (lo + step * F.col("bin")).alias("low"), (lo + step * (F.col("bin") + 1)).alias("high"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("n")
    )


def clipped_means(df: DataFrame, group: str, value: str, most: int = 5) -> DataFrame:
    """The mean of a value by another column cut off at ``most``; nulls don't count, nor does a null group."""
    return df.where(F.col(group).isNotNull()).groupBy(F.least(F.col(group), F.lit(most)).alias(group)).agg(F.avg(value).alias(f"mean_{value}"))


def type_counts(recommended: DataFrame) -> DataFrame:
    """One row: n_public, n_private."""
    kind = F.col("facility_type")
    return recommended.agg(F.count_if(kind == "public").alias("n_public"), F.count_if(kind == "private").alias("n_private"))


def bounds(cells: DataFrame) -> DataFrame:
    """One row: the whole extent and its middle."""
    whole = cells.agg(F.min("x0").alias("min_lon"), F.min("y0").alias("min_lat"), F.max("x1").alias("max_lon"), F.max("y1").alias("max_lat"))
    return whole.withColumns({"mid_lon": (F.col("min_lon") + F.col("max_lon")) / 2, "mid_lat": (F.col("min_lat") + F.col("max_lat")) / 2})


def totals(cells: DataFrame, estimated: Column | None = None) -> DataFrame:
    """One row: cells, population, facilities and, if asked, cells with an estimate."""
    extra = [] if estimated is None else [F.count(estimated).alias("estimated")]
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("population").alias("population"), F.sum("existing_clinics").alias("facilities"), *extra)


def bar_facts(report: DataFrame) -> DataFrame:
    """One row of the validation bars: before, model_after, baseline_after and the two improvements."""
    model, naive = F.col("scenario") == "model", F.col("scenario").startswith("baseline")
    return report.agg(
        F.max(F.when(model, F.col("before"))).alias("before"), F.max(F.when(model, F.col("after"))).alias("model_after"), F.max(F.when(naive, F.col("after"))).alias("baseline_after"),
        F.max(F.when(model, F.col("improvement"))).alias("model_improvement"), F.max(F.when(naive, F.col("improvement"))).alias("baseline_improvement"),
    )


def type_agreement(predicted: DataFrame, held_out: DataFrame) -> DataFrame:
    """One row over the ids in both tables (id, facility_type): n, accuracy, and F1 of ``public``; null where undefined."""
    joined = predicted.select("id", F.col("facility_type").alias("_p")).join(held_out.select("id", F.col("facility_type").alias("_t")), "id")
    p, t = F.col("_p") == "public", F.col("_t") == "public"
    hit, wrong, missed = F.count_if(p & t), F.count_if(p & ~t), F.count_if(~p & t)
    return joined.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("_p") == F.col("_t")).cast("double")).alias("accuracy"), F.try_divide(2.0 * hit, 2 * hit + wrong + missed).alias("f1_public")
    )


def hide_facilities(facilities: DataFrame, registry: DataFrame, fraction: float, *, key: str = "name", seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facilities left, registry left, hidden registry rows): about a fraction of the keys, by hash, gone from both tables."""
    share = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    hidden = registry.where(F.col(key).isNotNull() & (share < fraction))
    keys = hidden.select(key).distinct()
    return facilities.join(keys, key, "left_anti"), registry.join(keys, key, "left_anti"), hidden
