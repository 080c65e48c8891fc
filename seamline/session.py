"""Session settings and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this package relies on (UTC) or profits from (adaptive execution).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", folder: str | None = None) -> SparkSession:
    """A local session for tests and the bench, with `folder` for cuts; a cluster brings its own."""
    build = SparkSession.builder.master(f"local[{cores}]").appName("seamline")
    conf = SETTINGS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    if folder:
        conf["spark.checkpoint.dir"] = f"file://{folder}"
    for key, value in conf.items():
        build = build.config(key, value)
    spark = build.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many partitions as there are cores if its files give fewer, for work that is heavy per row.

    With at least as many splits as cores, as any large table has, it is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
