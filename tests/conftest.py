import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kerbwise.session import get_session  # noqa: E402

DATA = os.environ.get("KERBWISE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "kerbwise-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__sql__maxMetadataStringLength="10000",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="kerbwise-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def incidents(spark, small):
    from kerbwise.session import written
    from kerbwise.sources.warehouse import incidents as build

    return written(build(spark, small), "test-incidents")
