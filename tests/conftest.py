import pytest

from threadtide.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests", **{"spark.ui.showConsoleProgress": "false"})
