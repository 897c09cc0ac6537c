import os
import sys

import pytest

os.environ.setdefault("EVIDRA_CHECKPOINT_DIR", "/tmp/evidra-checkpoints")

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from evidra.session import local_session
    return local_session(8, "evidra-tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"})
