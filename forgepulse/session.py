"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# HotSpot does not compile methods above 8,000 bytes of bytecode, while Spark generates code up
# to 65,535 bytes into one method. The wide projections here run several times faster when Spark
# falls back to the split form instead.
#
# A task here sorts the rows of its partition up to a dozen times in a row, each time wider, and holds them
# all: some 30 bytes of memory a byte shuffled. So partitions are kept small, and cut finely enough
# that they stay so as the input grows. The same goes for splits of files, which a task sorts by account before the
# shuffle: Spark makes them as large as size / cores, up to 128 MB, so they are held to a size of their own.
RUNTIME_SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
    "spark.sql.files.maxPartitionBytes": "8MB",
}
INITIAL_PARTITIONS = 2000


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    wanted = max(INITIAL_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return spark


def build_session(
    app_name: str = "forgepulse", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with AQE on and the runtime settings; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app_name).config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())
