"""A session with the settings the library is designed for."""

from pyspark.sql import SparkSession


def session(name: str = "kindred", **conf) -> SparkSession:
    b = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
