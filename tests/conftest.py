import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.support import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, checkpoint=str(tmp_path_factory.mktemp("checkpoint")))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
