from __future__ import annotations

import os
import sys
import pytest
from pyspark.sql import SparkSession

from support import hours

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    from tapewright.session import build_session

    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_candles(spark):
    """Hourly candles of one instrument from closes, with optional columns."""

    def make(closes, symbol="BTC/USDT", times=None, **columns):
        n = len(closes)
        get = lambda name, default: columns.get(name, default)
        rows = [
            (symbol, "spot", "1h", (times or hours(n))[i], *[None if get(c, closes)[i] is None else float(get(c, closes)[i]) for c in ("open", "high", "low")],
             None if closes[i] is None else float(closes[i]), float(get("volume", [1.0] * n)[i]), int(get("trade_count", [1] * n)[i]))
            for i in range(n)
        ]
        return spark.createDataFrame(rows, "symbol string, market string, timeframe string, open_time timestamp, open double, high double, low double, close double, volume double, trade_count long")

    return make
