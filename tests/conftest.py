import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from revforge.session import ensure_checkpoint_dir, ship_package

    s = (SparkSession.builder.master("local[4]").appName("revforge-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="revforge-test-ckpt-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def reviews(spark):
    """FIXTURES.md section 3.1: twelve hand-made reviews (raw short codes)."""
    rows = [
        (1, "Crashes on start", "PD"), (2, "Add dark mode please", "FR"), (3, "Great app", "RT"),
        (4, None, "UE"), (5, "", "PD"), (6, "\U0001F600\U0001F600", "UE"),
        (7, "Don't like the new\nlayout", "UE"), (8, "Love it", None), (9, "Bug bug!!", "PD"),
        (10, "Good stuff", "RT"), (11, "Nice", "XX"), (12, "crash now", "PD"),
    ]
    return spark.createDataFrame(rows, "row_id long, review string, label string")
