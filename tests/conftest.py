import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from scoreweave.session import local_session

    return local_session("scoreweave-tests", 8)


@pytest.fixture(scope="session")
def matrix(spark):
    """Build a prepared-shaped table from numpy arrays."""

    def build(x, y, task="binary", dataset="d", splits=None):
        rows = [
            (dataset, splits[i] if splits else "train", task, str(i), float(y[i]), [None if v is None else float(v) for v in x[i]])
            for i in range(len(y))
        ]
        return spark.createDataFrame(
            rows,
            "dataset_name string, split string, task string, row_id string, label double, features array<double>",
        )

    return build
