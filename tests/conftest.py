import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.runtime import get_spark

    return get_spark("local[4]", 4, "tests")
