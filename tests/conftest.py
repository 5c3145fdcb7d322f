import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from proofline.session import local_session, ship

    s = local_session(8, 4, spark__sql__autoBroadcastJoinThreshold="10m")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
