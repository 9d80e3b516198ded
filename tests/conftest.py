import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from attesta.session import get_spark, ship_code

    session = get_spark("attesta-tests", cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    ship_code(session)
    yield session
