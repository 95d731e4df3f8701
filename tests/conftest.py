import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegauge.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]", shuffle_partitions=4,
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def sensor_rows(spark):
    """Builds sensor rows from a few fields; the rest are defaults."""
    from pyspark.sql import functions as F

    from tidegauge.schemas import fill_defaults

    def build(rows, schema="seq long, device_id string, time timestamp"):
        df = spark.createDataFrame(rows, schema)
        given = {
            "device_type": "multisensor", "customer_id": "customer_0001", "site_id": "site_001",
            "temperature": 20.0, "humidity": 50.0, "pressure": 1000.0, "battery_level": 90.0, "status": 1,
        }
        df = df.withColumns({k: F.lit(v) for k, v in given.items() if k not in df.columns})
        return fill_defaults(df)

    return build
