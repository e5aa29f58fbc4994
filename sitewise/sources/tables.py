"""Tables between stages: cells in Parquet, small tables in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewise import schemas


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def load_recommended(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.RECOMMENDED)


def load_prices(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.PRICES)


def load_validation(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.VALIDATION)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """name, facility_type of a licence registry."""
    return _csv(spark, path, "name string, facility_type string")
