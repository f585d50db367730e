import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from inkwell.session import local_session

    s = local_session(int(os.environ.get("TEST_CPUS", "4")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Sorted tuples of a frame, nulls first."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda t: [(x is not None, str(type(x)), x) for x in t])
