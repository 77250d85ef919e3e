import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from eralex.runtime import builder

    shared = tmp_path_factory.mktemp("shared")
    s = builder("tests", "4", 4).config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
