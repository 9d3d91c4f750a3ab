"""Importing this module registers every query."""

from catalog import cleaning, forecasts, panels, reports  # noqa: F401
