import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sluice.session import local_session

    session = local_session("tests", 4, 4, spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__sql__streaming__forceDeleteTempCheckpointLocation="true")
    yield session
    session.stop()
