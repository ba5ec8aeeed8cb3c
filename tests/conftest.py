import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from lexivane.session import local_session

    session = local_session(partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def triplets(spark):
    rows = [
        (0, "hi there", "hallo", None),
        (1, "what now", None, "no"),
        (2, "bye", "hej", "nix"),
        (3, "blank", "  \t", "x"),
    ]
    return spark.createDataFrame(rows, "idx bigint, query string, positive string, negative string")
