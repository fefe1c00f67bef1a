"""Session helpers. Settings here only fill gaps: a cluster's own settings always win."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "quillbar") -> SparkSession:
    """A local session for tests and the benchmark."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors, once for each application, for Python that runs there.

    Where the package is installed on all machines, or given by ``--py-files``, this is not needed.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="quillbar-"), "quillbar.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark


def shuffle_width(spark: SparkSession) -> int:
    """The session's shuffle partition count (200 if the platform chooses it by itself)."""
    width = spark.conf.get("spark.sql.shuffle.partitions", "200")
    return int(width) if width.isdigit() else 200


def materialize(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Compute a table once and cut its lineage, in ``folder`` or else the shared folder of ``spark.checkpoint.dir``.

    Without either, a local session gets a folder of its own; a cluster raises, since only its owner knows
    which folder all executors share.
    """
    context = df.sparkSession.sparkContext
    folder = folder or context.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillbar-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()
