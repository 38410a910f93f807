import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from tracehound.session import build_session
    s = build_session("local[4]", 4, app_name="tracehound-tests",
                      extra={"spark.ui.showConsoleProgress": "false",
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tracehound-tests-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
