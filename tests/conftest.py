from __future__ import annotations

import pathlib
import sys
import tempfile

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from clickward.session import allow_local_scratch, build_session, clear_scratch

    session = build_session(
        "clickward-tests",
        "local[8]",
        4,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="clickward-warehouse-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    allow_local_scratch(session)
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture()
def tight(spark):
    """Limits so low that every path for hot groups and large tables runs."""
    values = {"spark.clickward.maxGroupRows": "20", "spark.clickward.broadcastRows": "5"}
    for key, value in values.items():
        spark.conf.set(key, value)
    yield
    for key in values:
        spark.conf.unset(key)
