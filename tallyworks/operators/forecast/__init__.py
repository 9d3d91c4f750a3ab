"""Forecasts of all series in one job.

A series table has at least one key column, ``date`` and ``value``, one row per period. A series is as
long as the calendar, so it may be gathered in one row; the number of series is unbounded.
"""
