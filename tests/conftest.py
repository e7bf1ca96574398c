import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pagemill.session import get_session
    s = get_session("local[*]", shuffle_partitions=8,
                    extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                           "spark.driver.memory": "8g"})
    yield s
    s.stop()
