"""Files in the shared folder, read and written by tasks through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreweave.session import cut_lineage, ensure_checkpoint_dir

#: Rows of a table that may be broadcast; a larger one takes a shuffled join.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def open_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def bounded(df: DataFrame) -> DataFrame:
    """A table written once, marked for broadcast if its counted rows are few enough."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
