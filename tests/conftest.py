import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tabfold.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 8, app_name="tabfold-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tabfold-test-ckpt-")})
    yield s
    s.stop()
