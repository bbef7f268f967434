import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from stackroom.session import get_spark

    s = get_spark(
        "tests", "local[4]",
        **{"spark__sql__shuffle__partitions": "4", "spark__driver__memory": "3g", "spark__ui__showConsoleProgress": "false", "spark__sql__adaptive__coalescePartitions__parallelismFirst": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())
