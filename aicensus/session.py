"""Session settings and the few helpers that touch cluster-level state."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Rows of a configuration table that the driver may hold.
CONFIG_MAX_ROWS = 20_000


def build_session(app: str = "aicensus", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package relies on. Values passed in win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot side of a join even where that costs one more shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Rows carry whole files: small Arrow batches keep Python workers small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folders that this process named, for ``drop_stored``.
_FOLDERS: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Without the setting a temporary folder is taken in local mode only; on a cluster that is an error rather
    than a silent local write.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="aicensus-")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    return folder


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables stored so far by this process; DataFrames over them cannot be read any more. Returns their number.

    Nothing else deletes them: call it when a job's results are written.
    """
    conf, dropped = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _FOLDERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped


def stored(df: DataFrame, name: str, by: tuple[str, ...] = (), group_bytes: int | None = None) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back.

    Later steps read only the columns, row groups and partitions (``by``) they need, and an executor lost later costs
    nothing. Smaller row groups (``group_bytes``) let a small table be read by many tasks.
    """
    folder = shared_folder(df.sparkSession, name)
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", str(group_bytes))
    writer.partitionBy(*by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def collect_config(df: DataFrame, max_rows: int = CONFIG_MAX_ROWS) -> list:
    """Bring a configuration table (rules, controls) to the driver; too large is an error."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"configuration table holds more than {max_rows} rows")
    return rows


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="aicensus-ship-")) / "aicensus_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
