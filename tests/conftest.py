import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from staylens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("staylens-tests", cpus=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
