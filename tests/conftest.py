import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from joblens.session import local_session  # noqa: E402

# Small enough that the test tables have hot keys and several chunks.
SMALL = {"hot_rows": 40, "cuts": 128}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        8, "6g", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)
