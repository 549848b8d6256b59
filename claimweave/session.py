"""Session settings that the operators rely on."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; ``master`` only for local runs."""
    builder = SparkSession.builder.appName("claimweave").config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()
