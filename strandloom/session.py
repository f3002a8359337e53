"""A local session with the settings that the engine is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", **more: str) -> SparkSession:
    """Clusters bring their own settings; only a local session needs these."""
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.parquet.enableVectorizedReader": "true",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName("strandloom").config(map=conf | more).getOrCreate()
