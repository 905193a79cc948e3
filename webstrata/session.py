"""Session defaults; a session made elsewhere (a cluster's) is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", app: str = "webstrata", **conf: str) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
               .config("spark.ui.enabled", "false")
               # no stack trace per column expression: it dominates the time to build a query
               .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
