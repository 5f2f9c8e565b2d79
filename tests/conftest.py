from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plantpulse.plans.config import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", shuffle_partitions=8, app_name="plantpulse-tests")
    yield s


def _ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


# The seven-row edge frame (FIXTURES.md section 4); unlisted measures are constant.
EDGE_ROWS = [
    # id, machine, timestamp, mode, temp, vib, power, speed, error, defect
    (1, 1, "2024-01-05 23:59:00", "Active", 50.0, 4.5, 4.0, 100.0, 6.0, 2.0),
    (2, 1, "2024-01-06 00:00:00", "Active", 70.0, 4.75, 6.0, 200.0, 1.0, 4.0),
    (3, 1, "2024-01-07 12:00:00", "Idle", 85.0, 3.0, 2.0, 0.0, 7.0, 6.0),
    (4, 1, "2024-01-08 06:30:00", "Active", 85.25, 5.0, 8.0, 400.0, 9.0, 0.0),
    (5, 2, "2024-01-06 00:00:00", "Active", 49.75, 1.0, 5.0, 250.0, 5.0, 10.0),
    (6, 2, "2024-01-08 08:00:00", None, None, 1.0, 5.0, 250.0, 12.0, 11.0),
    (7, 3, "2024-01-08 09:00:00", "Active", 60.0, 4.0, 1.0, 1000.0, 0.0, 9.8),
]


@pytest.fixture(scope="session")
def edge_readings(spark):
    from plantpulse.schema import READINGS

    rows = [(i, m, _ts(t), mode, "Low", temp, vib, pw, sp, err, dfc, 1.0, 1.0, 0.5)
            for i, m, t, mode, temp, vib, pw, sp, err, dfc in EDGE_ROWS]
    return spark.createDataFrame(rows, READINGS)


@pytest.fixture(scope="session")
def edge_star(spark, edge_readings):
    from plantpulse.operators.clean import as_converted
    from plantpulse.operators.star import build_star, empty_star

    return build_star(as_converted(edge_readings), empty_star(spark))
