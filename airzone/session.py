"""A session for tests, benchmarks and trying things out on one machine.

On a cluster use the session you are given; the engine sets nothing on it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "airzone", cores: int | str = 8, memory: str = "8g") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(name)
             .config("spark.sql.shuffle.partitions", str(cores) if cores != "*" else "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
