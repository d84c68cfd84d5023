import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from roadlens.session import tune  # noqa: E402
from workload.queries import with_local_folder  # noqa: E402
from workload.check import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*")
    session.sparkContext.setLogLevel("ERROR")
    yield with_local_folder(tune(session))
    session.stop()
