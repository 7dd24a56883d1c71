import pytest


@pytest.fixture(scope="session")
def fixture_dir():
    return "/root/testdata/sf0.001"
