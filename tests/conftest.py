import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barcheck.session import local_session, use_utc  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(shuffle_partitions=4, app="tests")
    use_utc(s)
    yield s
    s.stop()
