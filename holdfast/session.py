"""The session that the jobs run in."""

from __future__ import annotations

from pyspark.sql import SparkSession

ZONE = "UTC"


def job_session(name: str, **settings: str) -> SparkSession:
    """A session whose days are UTC days.

    Days, ids and folder names derive from timestamps, so a job in another zone would file
    its rows under other days. A running session with another zone is refused.
    """
    builder = SparkSession.builder.appName(name)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    running = SparkSession.getActiveSession()
    if running is None:
        builder = builder.config("spark.sql.session.timeZone", ZONE)
    spark = builder.getOrCreate()
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in (ZONE, "Etc/UTC", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone is {zone}; the jobs need {ZONE}")
    return spark
