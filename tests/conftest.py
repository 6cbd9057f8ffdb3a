import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from signalweir.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        **{
            "spark.sql.streaming.stateStore.providerClass":
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        }
    )
    yield session
    session.stop()
