import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from kestrel_kg.session import get_session

    session = get_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "2g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()
