"""plantpulse: machine-sensor analytics (OEE, quality, energy, failures) on Spark.

Layers
------
- ``sources``   : CSV / staging (raw landing) / warehouse (bucketed star) I/O, fixtures
- ``functions`` : reusable Column expressions (bands, flags, time keys, display)
- ``operators`` : cleaning, star loading, analytical queries, charts, fleet KPIs, models
- ``plans``     : session configuration for scale and plan inspection helpers
- ``streaming`` : incremental micro-batch loading of landed raw files into the star
- ``etl``       : the end-to-end load as one call / a spark-submit entry point
"""

from plantpulse.schema import *  # noqa: F401,F403
