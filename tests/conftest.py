import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tracelake.session import build_session, share_code  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    share_code(session)
    yield session
    session.stop()
