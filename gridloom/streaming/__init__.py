"""Features as they arrive: GeoJSON files of a folder as a stream, and the validation report of all that has come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators import validation
from gridloom.sources import geojson


def feature_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The features of every file of a folder, each file once."""
    geojson.register(spark)
    return spark.readStream.format("geojson").load(folder)


def running_report(features: DataFrame) -> DataFrame:
    """The report over all features so far, for output mode complete: one row of state, whatever has arrived."""
    return validation.validate(features)
