"""Result tables, fitted models and the run log."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Overwrite ``path`` with the table; CSV gets a header. Written in parallel, never gathered."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)


class RunLog:
    """Append-only log of runs: parameters, metrics, artifacts and models.

    Single entries are buffered and written together; scores that already are
    a table are appended as one, without passing through the driver.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.run_id: str | None = None
        self._pending: list[tuple] = []

    def start_run(self, name: str | None = None) -> str:
        stamp = dt.datetime.now(dt.UTC)
        self.run_id = uuid.uuid4().hex
        self._add("run", "start", name or f"run-{stamp:%Y-%m-%dT%H:%M:%S}")
        return self.run_id

    def end_run(self) -> None:
        self._add("run", "end", "")
        self.flush()
        self.run_id = None

    def log_param(self, key: str, value) -> None:
        self._add("param", key, str(value))

    def log_metric(self, key: str, value) -> None:
        self._add("metric", key, repr(float(value)))

    def log_artifact(self, path: str) -> None:
        self._add("artifact", path, path)

    def log_model(self, model, key: str, folder: str) -> bool:
        """Save a model that can be saved; one that cannot is logged as an error."""
        try:
            model.save(f"{folder}/{key}")
        except Exception as err:
            self._add("error", key, f"{type(err).__name__}: {err}")
            return False
        self._add("model", key, f"{folder}/{key}")
        return True

    def log_metrics_table(self, scores: DataFrame, keys: tuple[str, ...], metrics: tuple[str, ...]) -> None:
        """Append every metric of a score table under the key ``<keys joined>_<metric>``."""
        long = scores.unpivot(list(keys), list(metrics), "metric", "score")
        rows = long.select(
            F.lit(self._id()).alias("run_id"),
            F.lit("metric").alias("kind"),
            F.concat_ws("_", *keys, "metric").alias("key"),
            F.col("score").cast("string").alias("value"),
            F.current_timestamp().alias("ts"),
        )
        rows.write.mode("append").parquet(self.path)

    def flush(self) -> None:
        if self._pending:
            self.spark.createDataFrame(self._pending, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self._pending = []

    def read(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(self.path)

    def _id(self) -> str:
        if self.run_id is None:
            raise RuntimeError("no run has been started")
        return self.run_id

    def _add(self, kind: str, key: str, value: str) -> None:
        self._pending.append((self._id(), kind, key, value, dt.datetime.now(dt.UTC)))
