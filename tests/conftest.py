import pytest

from tidewatch.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__adaptive__coalescePartitions__parallelismFirst="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def rows():
    """Sorted rows of a frame as tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
