import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from uipatterns.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def page(spark):
    """One page of HTML as the pages table."""
    def make(*bodies, url="https://shop.example/p/1", lang="en"):
        rows = [(i + 1, url, f'<html lang="{lang}"><body>{b}</body></html>') for i, b in enumerate(bodies)]
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    return make
