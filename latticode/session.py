"""A session for tests and benchmarks on one machine."""

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, name: str = "latticode", **conf: str) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
               .config("spark.sql.shuffle.partitions", str(cpus))
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
