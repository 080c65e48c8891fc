import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from seamline import cuts
    from seamline.session import local_session

    session = local_session(4, partitions=4, memory="4g", folder=str(tmp_path_factory.mktemp("cuts")))
    yield session
    cuts.drop_cuts(session)


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test data")
    return str(DATA)
