"""Session helpers shared by tests, bench and examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of whole texts, on which work is bound by CPU.
TEXTS = ("documents", "pages", "conversations")


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings that the queries are tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("maskwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if a few row groups would leave most of them idle; a table of many splits stays as it is.

    A table of one row group is one task however many splits its file has. Counting the splits that have rows reads
    footers only, and is done only where there are no more splits than two a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() > 2 * cores:
        return df
    used = df.select(F.spark_partition_id()).distinct().count()
    return df.repartition(cores) if used * 2 <= cores else df
