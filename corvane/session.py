"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: State on disk: ids that are kept for ever, timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build(app: str = "corvane", **extra: str) -> SparkSession:
    """A session in UTC with adaptive execution; cluster size, memory and partitions stay the cluster's own."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        **extra,
    }
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()
