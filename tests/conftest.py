import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
os.environ["PYSPARK_PYTHON"] = sys.executable


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from inkfield.session import build_session

    session = build_session("tests", "local[4]", shuffle_partitions=4, memory="3g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = Path(os.environ.get("INKFIELD_TESTDATA", "/root/testdata/sf0.001"))
    if not folder.exists():
        pytest.skip("no test tables")
    return str(folder)
