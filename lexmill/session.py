"""Session helpers shared by tests, bench and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: str | int = 8, app: str = "lexmill", memory: str = "12g") -> SparkSession:
    """A local session with AQE on and as many shuffle partitions as cores."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("LEXMILL_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
