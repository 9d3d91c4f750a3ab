"""End-to-end plans, from raw facts to panel, report and forecast."""
