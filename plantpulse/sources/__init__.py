"""Sources and sinks: CSV input, raw staging, the bucketed star warehouse and
the test fixtures derived from the driver's ``events`` table."""

from plantpulse.sources.files import count_staged, land_raw, read_csv, read_staged  # noqa: F401
from plantpulse.sources.fixture import dirty_raw, raw_from_readings, sensor_readings  # noqa: F401
