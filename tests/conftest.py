import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from siltstone.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("4", "tests")
    s.conf.set("spark.sql.shuffle.partitions", "2")
    s.conf.set("spark.sql.codegen.wholeStage", "false")  # tiny inputs: compiling would take most of the time
    yield s
    s.stop()
