"""Operators: cleaning, star loading, the analyses, chart data, fleet KPIs, models.

All are functions from DataFrames to lazy DataFrames; none collects data."""
