import pytest


@pytest.fixture(scope="session", autouse=True)
def staging(spark):
    yield
    from jobloom.llm.common import clear_staging

    clear_staging()
