import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session, shared_dir

    session = local_session("tests", "8")
    shared_dir(session)
    yield session
    session.stop()
