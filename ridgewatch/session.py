"""Session and table helpers shared by the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ridgewatch", master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with UTC time and adaptive execution; on a cluster the submitter's settings hold."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
