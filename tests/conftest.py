import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from popstat.session import delete_scratch, local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, "4g")
    ship_package(session)
    yield session
    delete_scratch(session)
    session.stop()
