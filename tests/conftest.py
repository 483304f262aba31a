import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hearthline import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
