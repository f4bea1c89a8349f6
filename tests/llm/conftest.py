"""Session of the operator tests: local, a few partitions, a scratch checkpoint folder."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tabfold.session import build_session

    return build_session("local[4]", 4, extra={"spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
