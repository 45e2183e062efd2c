"""Session settings and durable staging."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Long expressions are thousands of Column calls; recording a call site for each costs
# more than building the plan does.
CALL_SITES = "spark.python.sql.dataFrameDebugging.enabled"


def local_session(app: str, cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config(CALL_SITES, "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged data: what the cluster names, or a temp folder in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="postmill-stage-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all cores by `keys`.

    A few MB of Parquet hold millions of short rows and are read by one task or two. What costs is the
    work on each row, so it is put behind a shuffle of the columns it needs.
    """
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once to reliable storage so that later reads see the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
