"""Continuous loading: landed raw files -> star, one micro-batch at a time."""

from plantpulse.streaming.incremental import start_incremental_load  # noqa: F401
