"""Reusable Column expressions: all JVM built-ins, no Python UDFs."""

from plantpulse.functions.columns import *  # noqa: F401,F403
from plantpulse.functions.display import *  # noqa: F401,F403
