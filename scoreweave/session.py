"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "scoreweave", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks.

    On a cluster, create the session yourself: the library sets nothing that
    a cluster operator would want to size (executors, shuffle partitions).
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application, so that tasks import it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        home = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="scoreweave-ship-")) / f"{home.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(home.rglob("*.py")):
                out.write(file, file.relative_to(home.parent))
        sc.addPyFile(str(archive))
        _SHIPPED.add(sc.applicationId)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder lineage is cut into.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    that names none gets a temporary one; a cluster session without one is an
    error, because a machine-local folder is lost with its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="scoreweave-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing = threading.Lock()
_writes: dict[str, list] = {}  # by application: writes under way, and the setting before the first of them


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what is written in here when it is written, not at some later garbage collection."""
    app = spark.sparkContext.applicationId
    with _writing:
        state = _writes.setdefault(app, [0, spark.conf.get(_CLEANUP, None)])
        state[0] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _writing:
            state[0] -= 1
            if not state[0]:
                del _writes[app]
                if state[1] is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, state[1])


def measured(df: DataFrame) -> DataFrame:
    """``df`` written once, so that Spark plans with the size of its files.

    For tables that are small as a rule, such as a row per table or feature:
    they are broadcast as long as they are below the session's threshold, and
    joined by a shuffle beyond it. Nothing here hints a broadcast.
    """
    return cut_lineage(df)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` over several tasks a core, which adaptive execution does not merge.

    For steps that take far longer than the bytes they read suggest.
    """
    spark = df.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(most, *columns)


#: Bytes of the row groups of tables whose rows are read again and again. A task reads whole row groups.
ROW_GROUP = 4 << 20


def cut_lineage(df: DataFrame, partition_by: Sequence[str] = (), row_group: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    What is read back has no lineage before the files, survives lost
    executors, and keeps column pruning and partition pruning. Nobody reads the
    shuffles of the write again, so their files go with it. Rows that one task
    has written are read by several if ``row_group`` is smaller than its share.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    with shuffles_removed(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
