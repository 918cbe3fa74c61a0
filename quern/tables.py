"""Reading the named tables."""

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")
