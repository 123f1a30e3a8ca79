"""Session factory and table access shared by every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(app: str = "tidemark", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the queries rely on: UTC and adaptive execution. conf: more, with _ for the dots."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config(map={k.replace("_", "."): v for k, v in conf.items()})
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a lazily read frame; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
