"""Session helpers shared by the entry module, the bench and the tests."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, shuffle: int | None = None) -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("xsfactor")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return importable(spark)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local master import this package wherever the driver was started."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        paths = [ROOT, *filter(None, sc.environment.get("PYTHONPATH", "").split(os.pathsep))]
        sc.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))
    return spark
