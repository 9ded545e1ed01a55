"""A session with the settings that the operators' results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Results depend on these: time stamps are read as UTC and later keys win in map_concat.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session; on a cluster, build your own and call ``pin`` on it."""
    builder = SparkSession.builder.master(master).appName("ragspark")
    builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.ui.enabled", "false")
    return pin(builder.config(map={**PINNED, **conf}).getOrCreate())


def pin(spark: SparkSession) -> SparkSession:
    for key, value in PINNED.items():
        spark.conf.set(key, value)
    return spark
