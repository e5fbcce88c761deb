import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from guidemill.session import ensure_checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", app="guidemill-tests")
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """Frame of (doc_id, text) from plain strings."""

    def make(*items):
        return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "doc_id int, text string")

    return make
