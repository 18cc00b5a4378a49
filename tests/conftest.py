import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loomtrace.session import ensure_checkpoint_dir, local_session

    session = local_session()
    ensure_checkpoint_dir(session)
    yield session
    session.stop()
