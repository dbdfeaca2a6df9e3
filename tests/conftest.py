import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from placegraph.session import local_session

    s = local_session("8", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from placegraph.session import clear_run

    clear_run(s)
    s.stop()
