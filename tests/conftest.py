import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from fathom.session import build_session

    session = build_session(
        "tests", f"local[{os.environ.get('TEST_CPUS', '4')}]", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__driver__memory="4g",
    )
    yield session
    session.stop()
